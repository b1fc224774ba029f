"""Every named query against its SQL on the smallest tables."""

import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest

from tidewire.plans import named as queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(row):
    return str(tuple(float(v) if isinstance(v, Decimal) else v for v in row))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf_dir, con):
    df = queries.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in queries.ORACLE_SQL:
        assert got
        return
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(plain(r[n] for n in names) for r in got) == sorted(plain(r) for r in want.fetchall())


def test_whole_tables_of_related_and_relations(spark, sf_dir):
    ids = [r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    best = {}
    for i in ids:
        x, y = i % 37, (i * 3 + 1) % 37
        if x != y:
            for k in ((x, y), (y, x)):
                best[k] = max(best.get(k, 0), i % 97 / 100.0)
    want = set()
    for story in {x for x, _ in best}:
        others = sorted((-sim, y) for (x, y), sim in best.items() if x == story)[:2]
        want |= {(story, y, y * 2, n + 1) for n, (_, y) in enumerate(others)}
    got = queries.QUERIES["related_stories"](spark, sf_dir).select("story_id", "other", "articles", "rn").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type").collect()
    panel = queries.QUERIES["relations_panel"](spark, sf_dir).collect()[0]
    assert (panel.curr, panel.prev) == (sum(e.event_id % 7 for e in events), sum(e.event_id % 5 for e in events))
    assert panel.new + panel.surging + panel.cooling + panel.steady + panel.trace == len(events)


def test_library_stands_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['tidewire.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL)), "False"], out.stderr


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
