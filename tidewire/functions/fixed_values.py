"""Fixed values of the news rules: patterns and lists, whole and as they are."""

#: Headlines of streams, broadcasts, betting, leagues and single matches.
SPAM_DELIMITERS = r"(!\+!|\$\#|【[^】]*(?:live|canl[ıi]|stream|tv|ma[cç]|izle|watch)[^】]*】|\[(?:match|live|stream|watch|tv)[^\]]*\])"
SPAM_STREAMS = (
    r"\b(?:live\s+stream|livestream|stream\s+tv\s+channel|tv\s+channel\b.*\b(?:live|match|stream)|how\s+to\s+watch|watch\s+live|"
    r"free\s+live\s+stream|canl[ıi]\s+izle|canl[ıi]\s+yay[ıi]n|ne\s+zaman[,:\s]+saat\s+ka[cç]ta|hangi\s+kanalda|ver\s+en\s+vivo|"
    r"en\s+vivo\b.*\b(?:vs\.?|v\.?)\b|transmisi[oó]n\s+en\s+vivo|prediction\s+and\s+betting\s+tips|betting\s+tips|betting\s+odds|"
    r"stats\s*&\s*head-to-head|head-to-head\b.*\b(?:uefa|nations\s+league|concacaf|fifa|world\s+cup|premier\s+league|la\s+liga|"
    r"serie\s+a|bundesliga|champions\s+league|europa\s+league))\b"
)
SPAM_LEAGUES = (
    r"\b(?:uefa\s+nations\s+league|concacaf\s+nations\s+league|champions\s+league|europa\s+league|premier\s+league|la\s+liga|serie\s+a|"
    r"bundesliga|copa\s+am[eé]rica|echipa\s+național[ăa]|лиг[еаи]\s+наций|обзор\s+матча|первая\s+лига|تصفيات\s+أمم\s+أفريقيا|بهدف\s+قاتل)\b"
)
SPAM_MATCHES = (
    r"(?:\b(?:v|vs\.?)\s+[^\n,:;]{2,35}\s+(?:match\s+live|live\s+stream|prediction|betting|preview|highlights|stats)\b|"
    r"\bin\s+match\s+against\b|^\d+[-:]\d+[.\s]+.*\b(?:serie|liga|match|goal|gol|win|beat|defeat)\b)"
)
#: Outlets that only report sport, and hosts whose broadcasts are spam.
SPORTS_OUTLETS = [
    "dailysports", "tudn", "espn", "onefootball", "goal", "flashscore", "sofascore", "sky sports", "beinsports", "bein sports", "marca", "as",
    "l'équipe", "l'equipe", "nemzeti sport", "m4 sport", "trt spor", "a spor", "fanatik", "fotomac", "fotomaç", "sportbox", "championat",
    "championat.com", "championat.ru", "sports.ru", "российский футбольный союз", "алтайский спорт", "хоккейный клуб «динамо» москва",
    "sport.ua", "ua-football",
]
SPAM_HOSTS = ["universitat de barcelona", "日本取引所グループ", "ub.edu", "jpx.co.jp"]
SPAM_HOST_WORDS = r"\b(live|stream|match|canl[ıi]|izle|tv|vs\.?|v)\b"
#: Kinds of disaster, in order of precedence.
DISASTERS = [
    ("Storm & Cyclone", r"(?:\b(typhoon|cyclone|hurricane|tropical storm|tornado|gale|bão|siêu bão|áp thấp nhiệt đới|lốc xoáy|taufan|badai|bagyo|พายุ|မုန်တိုင်း|vihar|orkán|burza|tufão|ciclone|fırtına|kasırga)\b|台风|颱風)"),
    ("Flood & Landslide", r"(?:\b(flood|floods|flooding|flash flood|landslide|mudslide|inundation|lũ|lũ lụt|ngập lụt|ngập sâu|sạt lở|triều cường|banjir|longsor|pagbaha|baha sa|guho|น้ำท่วม|ดินถล่ม|ရေကြီး|árvíz|powódź|poplava|sel|heyelan|enchente|deslizamento)\b|暴雨|洪水|洪涝|洪澇|山体滑坡|山泥傾瀉|泥石流)"),
    ("Earthquake & Volcano", r"(?:\b(earthquake|tremor|seismic|tsunami|volcano|volcanic|eruption|động đất|núi lửa|sóng thần|gempa|gunung berapi|lindol|bulkan|แผ่นดินไหว|ငလျင်|földrengés|trzęsienie ziemi|zemljotres|deprem|yanardağ|terremoto|zəlzələ)\b|地震|海啸|海嘯|火山喷发|火山噴發)"),
    ("Wildfire & Drought", r"(?:\b(wildfire|forest fire|bushfire|drought|heatwave|cháy rừng|hạn hán|kebakaran hutan|kekeringan|ไฟป่า|ภัยแล้ง|erdőtűz|aszály|pożar lasu|suša|orman yangını|kuraklık|incêndio florestal|seca)\b|山火|森林火灾|森林火災|旱灾|旱災)"),
]
#: Kinds of violence, in order of precedence, and what rules them out.
VIOLENCE = [
    ("Insurgency & Terror", r"(?:\b(terror|terrorist|terrorism|insurgent|insurgency|militant|militants|boko haram|iswap|al-shabaab|isis|daesh|jihad|jihadist|taliban|houthi|houthis|hezbollah|hamas|ied|suicide bomb|car bomb|ambush|kidnap|kidnapped|abduct|abducted|hostage|massacre|khủng bố|bắt cóc|phiến quân)\b|恐怖袭击|恐怖襲擊|恐袭|恐襲|爆炸袭击|爆炸襲擊|人质|人質)"),
    ("Armed Clash & Strike", r"(?:\b(airstrike|air strike|drone strike|missile strike|shelling|shelled|mortar|artillery|armed clash|clashes|firefight|gunbattle|gunmen|bombardment|incursion|ceasefire violation|cross-border fire|tập kích|không kích|pháo kích|giao tranh)\b|空袭|空襲|炮击|砲擊|交火|武装冲突|武裝衝突)"),
    ("Civil Unrest & Crackdown", r"(?:\b(riot|riots|violent protest|clashes with police|tear gas|water cannon|curfew|martial law|coup|state of emergency|crackdown|mass arrest|looting|arson|bạo loạn|biểu tình|thiết quân luật|đảo chính)\b|暴动|暴動|骚乱|騷亂|镇压|鎮壓|宵禁|戒严|戒嚴|政变|政變)"),
]
NOT_VIOLENCE = r"\b(festival|dance|theatre|theater|concert|music|album|song|singer|film|movie|championship|tournament|league|match|coach|player|stadium|actor|actress|football|soccer|basketball|baseball|cricket|tennis|golf)\b"
VIOLENT_THEMES = ["civil unrest and armed conflict", "sectarian and confessional violence"]
#: Words of armed conflict and of its effects in addresses, and words that rule it out.
ARMED = (
    r"\b(airstrike|airstrikes|air-strike|drone-strike|drone-attacks|drone-attack|missile|shelling|shelled|mortar|artillery|bombing|bombed|"
    r"suicide-bomb|car-bomb|ied|ambush|ambushed|insurgent|insurgents|insurgency|militant|militants|militia|militias|rebel|rebels|terror|"
    r"terrorist|terrorism|jihadist|isis|iswap|boko-haram|al-shabaab|houthi|houthis|hezbollah|hamas|taliban|rsf|idf|troops|soldiers|military|"
    r"army|forces|clash|clashes|clashed|gunmen|kidnap|kidnapped|abduct|abducted|hostage|hostages|massacre|civilian-killings|"
    r"civilians-killed|riot|riots|protesters|crackdown|tear-gas|curfew|martial-law|coup|sectarian|synagogue|mosque|church|temple)\b"
)
IMPACT = (
    r"\b(attack|attacks|clash|clashes|ambush|strike|strikes|bomb|bombing|bombed|explosion|blast|shoot|shooting|shot|gunmen|kill|killed|"
    r"killing|dead|deaths|fatalities|casualties|massacre|kidnap|kidnapped|abduct|abducted|hostage|riot|riots|raid|raided|shelling|shelled|"
    r"wounded|injured|crackdown|arson)\b"
)
NO_CONFLICT = (
    r"\b(festival|dance|theatre|theater|concert|music|album|song|singer|film|movie|championship|tournament|league|match|coach|player|"
    r"stadium|actor|actress|ranking|rankings|washroom|stock|market|shares|box-office|cricket|football|soccer|basketball|baseball|golf|"
    r"tennis|car-crash|road-accident|house-collapse|wife|husband|boyfriend|girlfriend|divorce|faces-court|judge-rejects|bail|lion|lioness|"
    r"lions|tiger|tigress|tigers|leopard|bear|shark|crocodile|elephant|dog|dogs|snake|monkey|zoo|safari|poacher|bus-crash|train-crash|"
    r"drowned|drowning|gala|performs|performed|marks a year|returned hostage|former hostage)\b"
)
#: Travel advice that counts, routine notices that don't, and words that make advice of level 2 count.
ADVICE = (
    r"\b(terror|attack|conflict|missile|drone|airstrike|strike|clash|unrest|protest|demonstration|riot|curfew|martial|emergency|evacuat|"
    r"border|airspace|shelter|kidnap|hostage|violence|military|security|warning|advise against|earthquake|tsunami|volcano|cyclone|typhoon|"
    r"hurricane|flood|wildfire|landslide|explosion|gunmen|state of emergency)\b"
)
ROUTINE_ADVICE = (
    r"^(Removal of information|New information about entry requirements|Updated information about visa|Updated information about entry|"
    r"Updated information on passport|New information on entry)\b|\b(FIFA|World Cup|festival|Durga Puja|Carnival|Eurovision)\b"
)
CAUTION = r"\b(terror|unrest|conflict|kidnap|armed|violence)\b"
#: What elections are called.
ELECTION_TERMS = ["election", "választás", "bầu cử", "élection", "elección", "wahl", "wybory", "выборы", "seçim", "انتخابات"]
#: Words of opinion pieces.
OPINION = r"(?i)^(?:opinion|editorial|column|letters?|viewpoint|analysis\s*[:|])\s*|(?:\s*[-–|]\s*(?:opinion|editorial|columns?)$)"
#: Words that credit a wire agency.
WIRE_CREDITS = (
    r"\b(?:theo\s+ttxvn|nguồn:\s*ttxvn|\(ttxvn\)|theo\s+vna|\(vna\)|selon\s+l'aps|\(aps\)|\(belta\)|\(белта\)|\(тасс\)|\(ria\s+novosti\)|"
    r"\(риа\s+новости\)|\(reuters\)|\(ap\)|\(afp\)|\bafp\b|\breuters\b|\(xinhua\)|\(cns\))\b|(?:新华社|新華社|中新社|据新华社|據新華社|央视新闻|央視新聞)"
)

#: Kinds of disaster, of violence and of faith in folded titles (see `text.fold`), in order of precedence.
FOLDED_DISASTERS = [
    ("Storm & Cyclone", r"\b(typhoon|cyclone|hurricane|tropical storm|tornado|gale|sieu bao|ap thap nhiet doi|loc xoay|con bao|taufan|badai|bagyo|พายุ|မုန်တိုင်း|vihar|orkan|burza|tufao|ciclone|firtina|kasirga)\b"),
    ("Flood & Landslide", r"\b(flood|floods|flooding|flash flood|landslide|mudslide|inundation|lu lut|ngap lut|ngap sau|sat lo|trieu cuong|banjir|longsor|baha|guho|น้ำท่วม|ดินถล่ม|ရေကြီး|arviz|powodz|poplava|heyelan|enchente|deslizamento)"),
    ("Earthquake & Volcano", r"\b(earthquake|tremor|seismic|tsunami|volcano|volcanic|eruption|dong dat|nui lua|song than|gempa|gunung berapi|lindol|bulkan|แผ่นดินไหว|ငလျင်|foldrenges|trzesienie ziemi|zemljotres|deprem|yanardag|terremoto|zelzele)"),
    ("Wildfire & Drought", r"\b(wildfire|forest fire|bushfire|drought|heatwave|chay rung|han han|kebakaran hutan|kekeringan|ไฟป่า|ภัยแล้ง|erdotuz|aszaly|pozar lasu|susa|orman yangini|kuraklik|incendio florestal|seca\b)"),
]
FOLDED_VIOLENCE = [
    ("Insurgency & Terror", r"\b(terror|terrorist|terrorism|insurgent|insurgency|militant|militants|boko haram|iswap|al-shabaab|isis|daesh|jihad|jihadist|taliban|houthi|houthis|hezbollah|hamas|ied|suicide bomb|car bomb|ambush|kidnap|kidnapped|abduct|abducted|hostage|massacre|khung bo|bat coc)\b"),
    ("Armed Clash & Strike", r"\b(airstrike|airstrikes|air strike|drone strike|missile strike|shelling|shelled|mortar|artillery|armed clash|clashes|firefight|gunbattle|gunmen|bombardment|incursion|ceasefire|cross-border|khong kich|phao kich|giao tranh)\b"),
    ("Civil Unrest & Crackdown", r"\b(protest|protesters|riot|riots|demonstrat|curfew|martial law|coup|tear gas|water cannon|looting|crackdown|arson|bao loan|bieu tinh|thiet quan luat|dao chinh)\b"),
]
FAITHS = [
    ("Judaism", r"\b(synagogue|anti-semit|antisemit|jewish|judaism|kosher|rabbi|shul|yemenite jew|zsinagoga|zsido|antiszemita|bai do thai)\b"),
    ("Christianity", r"\b(christians|christianity|christian (?:faithful|minority|minorities|community|communities|group|groups|church|churches|pastor|priest|genocide|persecution|population|village|villages|family|families|civilian|civilians)|church|chapel|monastery|cathedral|priest|pastor|nuns|copt|coptic|chaldean|assyrian|maronite|evangelical|templom|lelkipasztor|lelkesz|puspok|kereszteny|nha tho|linh muc|giao dan)\b"),
    ("Islam", r"\b(mosque|minaret|imam|madrassa|madrasa|quran|koran|muslim|islam|islamic|islamist|rohingya|uyghur|uighur|ahmadiyya|hazara|shia|sunni|fatwa|mecset|muszlim|muzulman|nha tho hoi giao)\b"),
    ("Other Faiths & Sites", r"\b(yazidi|bahai|baha'i|hindutva|anti-conversion|blasphemy|sacred site|holy site|cemetery desecrat|pogrom|sectarian|interfaith|inter-communal|istenkaromlas|atterites|vallasi uldozes|giao phai)\b"),
]
#: Words of harm in folded titles, and words of arts and sport that rule it out.
HARM = (
    r"\b(attack|attacks|assault|clash|clashes|ambush|strike|strikes|airstrike|airstrikes|bomb|bombing|bombed|explosion|shoot|shooting|shot|gunmen"
    r"|gunbattle|firefight|kill|killed|killing|murder|murdered|dead|death|fatalities|casualties|massacre|behead|beheaded|slaughter|kidnap"
    r"|kidnapped|kidnapping|abduct|abducted|abduction|hostage|hostages|pogrom|lynch|lynched|arson|burned|burnt|firebomb|desecrat|vandaliz|persecut"
    r"|persecution|terror|terrorist|terrorism|militant|militants|militia|militias|insurgent|insurgency|jihad|jihadist|extremis|extremist|ied"
    r"|anti-conversion|blasphemy|forced conversion|expel|expels|expelled|expulsion|displaced|refugee|refugees|fled|fleeing|shelled|shelling|mortar"
    r"|artillery|drone strike|air strike|missile strike|riot|riots|tear gas|curfew|martial law|coup|crackdown|looting|looted|raid|raided"
    r"|mass grave|mass graves|tan cong|sat hai|giet|bat coc|khung bo|dot pha|pha huy|bao loan|khong kich|phao kich|giao tranh|merenylet|tamadas"
    r"|gyilkossag|emberrablas|lefejezes|gyujtogatas|rombolas)\b"
)
ARTS_OR_SPORT = (
    r"\b(festival|dance|choreodrama|theatre|theater|concert|music|album|song|singer|film|movie|championship|tournament|league|match|coach|player"
    r"|stadium|actor|actress|museum|art exhibition|ballet|opera|pfdk|football|soccer|basketball|baseball|cricket|tennis|golf)\b"
)
#: Where sentences end, and marks and verbs of quotation.
SENTENCE_END = r"(?<=[.!?…])\s+|(?<=[。！？])(?![”」』）\)])|(?<=[。！？][”」』）])"
QUOTE_CUES = (
    r'["“”«»「」『』]|(?:\b(?:said|stated|announced|confirmed|told|khẳng định|nhấn mạnh|tuyên bố|cho biết|chỉ đạo|yêu cầu|közölte|mondta)\b)|'
    r"(?:表示|指出|强调|強調|声明|聲明|宣布|宣佈|回应|回應)"
)
