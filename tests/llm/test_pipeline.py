import __spark_entry__ as entry
import corpus_pipeline as P
from riskloom.llm import simhash_groups as S, toxicity as T
from riskloom.llm.common import table
from test_decontaminate import holds
from test_packing import check
from test_simhash import fingerprint, groups

SMALL = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    """Every stage on what the one before it kept, next to a plain version of its decision."""
    docs = table(spark, SMALL, "documents")
    columns, steps = docs.columns, [docs.collect()]
    for name, stage in P.STAGES:
        frame = stage(spark, spark.createDataFrame(steps[-1], docs.schema), SMALL)
        assert name == P.STAGES[-1][0] or frame.columns == columns
        steps.append(frame.collect())
    start, clean, single, free, covered, pieces = steps
    model = T.learned(docs, table(spark, SMALL, "labels"))
    scores = {r["doc_id"]: r["s"] for r in T.scored(docs, model, "s").collect()}
    assert {r["doc_id"] for r in clean} == {i for i, s in scores.items() if s < 0.5} and len(clean) < len(start)
    prints = [fingerprint(r["text"]) for r in clean]
    least = {}
    for r, g in zip(clean, groups(prints, S.DISTANCE)):
        least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    assert {r["doc_id"] for r in single} == set(least.values()) and len(single) < len(clean)
    items = [r["text"] for r in table(spark, SMALL, "benchmark").collect()]
    assert {r["doc_id"] for r in free} == {r["doc_id"] for r in single if not any(holds(r["text"], x) for x in items)}
    before = {r["doc_id"]: r for r in free}
    assert {r["doc_id"] for r in covered} == set(before)
    assert all(r["text"] == before[r["doc_id"]]["text"] or "[SECRET]" in r["text"] for r in covered)
    assert sum(r["n_words"] for r in pieces) == sum(len(r["text"].split()) for r in covered)
    assert check(pieces, 2048)


def test_run_is_the_stages_in_order(spark):
    assert P.run(spark, SMALL).count() > 100  # of 200 documents
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scans", "packing"]


def test_awkward_rows(spark, awkward, nothing):
    for docs, most in ((awkward, awkward.count()), (nothing, 0)):
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == awkward.columns
        assert (P.STAGES[-1][1](spark, docs, SMALL).count() == 0) == (most == 0)


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
