import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import oracle  # noqa: E402

from lakelens.llm.queries import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(oracle.FOLDER).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, name, QUERIES[name], ORACLES[name])


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, oracle.FOLDER).collect()]


def test_the_other_queries_agree_with_those_that_have_sql(spark):
    """Queries that SQL cannot express: p3, p6 and p10 are tested against made cases in their own modules."""
    found, hidden = rows(spark, "p6_found"), {r["chunk_pos"]: r for r in rows(spark, "p6_redacted")}
    texts = {r.chunk_pos: r.text for r in spark.read.parquet(f"{oracle.FOLDER}/chunks.parquet").select("chunk_pos", "text").collect()}
    per = {}
    for r in found:
        per.setdefault(r["chunk_pos"], set()).add(r["secret"])
    assert found and hidden.keys() == texts.keys()
    for pos, text in texts.items():
        if pos not in per:
            assert hidden[pos]["text"] == text and hidden[pos]["n_secrets"] == 0
        else:
            assert all(s in text and s not in hidden[pos]["text"] for s in per[pos]) and hidden[pos]["n_secrets"] >= len(per[pos])
            assert all(b in (a, "x") for a, b in zip(text, hidden[pos]["text"]))
    pieces, cut = rows(spark, "p7_pieces"), {r["chunk_pos"] for r in rows(spark, "p7_found")}
    assert pieces and {r["chunk_pos"] for r in pieces} == cut and max(r["n_chars"] for r in pieces) <= 1600
    packed = rows(spark, "p8_packed")
    loads = {}
    for r in packed:
        loads[r["container"]] = loads.get(r["container"], 0) + r["n_tokens"]
    assert max(loads.values()) <= 2048 and sum(loads.values()) > 0.9 * 2048 * (len(loads) - 1)
    exact, near = ({(r["doc_id"], r["item_id"]) for r in rows(spark, n)} for n in ("p9_found", "p9_near"))
    assert exact and exact <= near
    assert {r["doc_id"] for r in rows(spark, "p10_messages")} == {r["doc_id"] for r in rows(spark, "p10_found")} != set()
    paths = {(r["project_id"], r["ref"], r["path"]) for r in rows(spark, "p3_found")}
    chunks = spark.read.parquet(f"{oracle.FOLDER}/chunks.parquet").select("project_id", "ref", "path").distinct().collect()
    assert paths and paths < {tuple(r) for r in chunks}
