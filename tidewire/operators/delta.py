"""A window compared with the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Story categories.
CATEGORIES = ["internal_politics", "economics", "foreign_policy", "defence_security", "society", "other"]


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many digits, half away from zero, as doubles are: 0.145 is below its half and gives 0.14. ``round`` goes by
    the shortest decimals that tell a double apart, and would give 0.15."""
    return F.round(x * 10**digits) / 10**digits


def period(at: Column, now: str, days: int) -> Column:
    """curr, prev or null."""
    start = F.expr(f"timestamp '{now}' - interval {days} days")
    before = F.expr(f"timestamp '{now}' - interval {2 * days} days")
    return F.when(at >= start, "curr").when(at >= before, "prev")


def state(curr: Column, prev: Column) -> Column:
    net, ratio = curr - prev, rounded(curr / F.greatest(F.lit(1), prev), 2)
    return (
        F.when((prev == 0) & (curr >= 2), "new").when((net >= 3) & (ratio >= 1.75), "surging")
        .when((net <= -3) & (ratio <= 0.40), "cooling").when(curr >= 2, "steady").otherwise("trace")
    )


#: What ``compared`` says of each story.
STORY_DELTA = ["story_id", "curr", "prev", "net", "ratio", "state", "velocity_z", "scope_shift", "state_share_curr", "state_share_prev", "state_surge", "state_recede"]


def story_deltas(members: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Per story: curr, prev, net, ratio, state, velocity_z, scope_shift, shares of state outlets and their surge.

    ``members``: story_id, at, similarity, scope, state_outlet.
    """
    rows = members.withColumn("p", period(F.col("at"), now, days)).where("p is not null")
    return compared(rows, ["story_id"]).select(*STORY_DELTA)


def compared(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Rows of both windows (p: curr or prev) compared per group: one aggregation, in batch as on a stream."""
    core = F.col("similarity") >= 0.93
    when = lambda name, c=F.lit(True): F.count_if((F.col("p") == name) & c)
    share = lambda name: rounded(F.coalesce(when(name, core & F.col("state_outlet")) / F.nullif(when(name, core), F.lit(0)), F.lit(0.0)), 2)
    out = rows.groupBy(*more, *by).agg(
        when("curr").alias("curr"), when("prev").alias("prev"),
        when("prev", F.col("scope") == "domestic").alias("pd"), when("curr", F.col("scope") == "international").alias("ci"),
        when("curr", F.col("scope") == "abroad_local").alias("ca"), when("curr", core).alias("cc"), when("prev", core).alias("cp"),
        share("curr").alias("state_share_curr"), share("prev").alias("state_share_prev"),
    )
    home_only = (F.col("prev") > 0) & (F.col("pd") == F.col("prev"))
    enough = (F.col("cc") >= 4) & (F.col("cp") >= 4)
    moved = rounded(F.col("state_share_curr") - F.col("state_share_prev"), 2)
    net = F.col("curr") - F.col("prev")
    return out.withColumns({
        "net": net, "ratio": rounded(F.col("curr") / F.greatest(F.lit(1), F.col("prev")), 2), "state": state(F.col("curr"), F.col("prev")),
        "velocity_z": rounded(net / F.sqrt(F.greatest(F.lit(1), F.col("prev"))), 2),
        "scope_shift": F.when(home_only & (F.col("ci") > 0), "international_pickup").when(home_only & (F.col("ca") > 0), "diaspora_pickup"),
        "state_surge": enough & (moved >= 0.3), "state_recede": enough & (moved <= -0.3),
    })


def agenda(rows: DataFrame, now: str, days: int = 7, categories: list[str] | None = None) -> DataFrame:
    """Per category, all of them: curr, prev, net, share of the window in percent and its change in points."""
    p = rows.withColumn("p", period(F.col("at"), now, days))
    sums = p.groupBy("category").agg(F.count_if(F.col("p") == "curr").alias("curr"), F.count_if(F.col("p") == "prev").alias("prev"))
    names = rows.sparkSession.createDataFrame([(c,) for c in categories or CATEGORIES], "category string")
    out = names.join(sums, "category", "left").fillna(0, ["curr", "prev"])
    total = out.agg(F.sum("curr").alias("tc"), F.sum("prev").alias("tp"))
    out = out.crossJoin(F.broadcast(total))  # one row
    part = lambda c, t: 100.0 * F.col(c) / F.greatest(F.lit(1), F.col(t))
    return out.select("category", "curr", "prev", (F.col("curr") - F.col("prev")).alias("net"), rounded(part("curr", "tc"), 1).alias("share_pct"), rounded(part("curr", "tc") - part("prev", "tp"), 1).alias("share_delta_pct"))


def with_prior_matches(members: DataFrame, matches: DataFrame, now: str, days: int = 7, least: float = 0.895, core: float = 0.91) -> DataFrame:
    """``members`` (story_id, id, at, similarity, scope, state_outlet) with the earlier window's rows that are near a story.

    ``matches``: story_id, id, sim, at, scope, state_outlet of rows of the window before. Those of ``least`` similarity
    join their story's earlier window, unless it has them already; from ``core`` on they count among its core.
    """
    names = ["story_id", "id", "at", "similarity", "scope", "state_outlet"]
    has = members.where(period(F.col("at"), now, days) == "prev").select("story_id", "id")
    new = matches.where((F.col("sim") >= least) & (period(F.col("at"), now, days) == "prev")).dropDuplicates(["story_id", "id"])
    new = new.join(has, ["story_id", "id"], "left_anti").withColumn("similarity", F.when(F.col("sim") >= core, 0.93).otherwise(0.9))
    return members.select(*names).unionByName(new.select(*names))


def prior_categories(prior: DataFrame, matches: DataFrame, least: float = 0.86) -> DataFrame:
    """(country, category, n) of the window before: a row (id, country, story_category, hint) counts for its story's
    category, else for that of the story it is near (``matches``: id, category, sim), else for its feed's hint, else as other."""
    near = matches.where(F.col("sim") >= least).groupBy("id").agg(F.max_by("category", F.struct("sim", "category")).alias("near"))
    known = lambda c: F.when(F.col(c).isin(CATEGORIES), F.col(c))
    first = F.coalesce("story_category", "near", known("hint"))
    rows = prior.join(near, "id", "left").withColumn("category", F.when(first.isin(CATEGORIES), first).otherwise("other"))
    return rows.groupBy("country", "category").agg(F.count("*").alias("n"))
