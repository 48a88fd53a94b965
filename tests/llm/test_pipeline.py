import corpus_pipeline
from veritrail.llm import queries
from veritrail.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_take_effect(spark, messy):
    docs = messy.select(*COLUMNS)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, ""), f"test-{name}")
        sizes.append(docs.count())
        if name != "pack":
            assert docs.columns == COLUMNS
        if name == "line_dedup":
            lines = [x for r in docs.collect() for x in (r.text or "").split("\n") if x]
            assert len(lines) == len(set(lines))
        if name == "simhash_dedup":
            rows = [tuple(r) for r in docs.collect()]
            assert len({r[1] or "" for r in rows}) == len(rows) and set(rows) <= {tuple(r) for r in before.collect()}
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[-1] > 0


def test_stages_take_empty_tables(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select(*COLUMNS), "").count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mix_sources", "pack"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
