"""Every registered query beside its SQL on the smallest tables; the entry points; independence of the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

from quern.queries import core


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def same(spark, data, name, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(sql)
    head = [d[0] for d in cur.description]
    want = sorted((tuple(plain(dict(zip(head, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want, name


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_core_query(spark, data, name):
    if name in core.SQL:
        same(spark, data, name, core.QUERIES[name], core.SQL[name])
    else:
        core.QUERIES[name](spark, data).collect()


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_subpackage():
    code = "import sys; sys.modules['quern.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_imports_the_subpackage():
    root = Path(__file__).resolve().parent.parent
    for p in root.glob("quern/**/*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quern.llm" not in p.read_text(), p
