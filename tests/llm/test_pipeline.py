import math

from pyspark.sql import functions as F

import corpus_pipeline as c
from postmill.llm import toxicity as toxic
from postmill.llm.common import table
from tests.llm.test_decontamination import plain as leaks
from tests.llm.test_line_dedup import plain as lines
from tests.llm.test_mixing import hold
from tests.llm.test_ngram_join import grams
from tests.llm.test_ngram_join import plain as classes


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    names, kept = docs.columns, {}
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == names
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        given = [(r.doc_id, r.text) for r in before.collect()]
        if name == "toxicity":
            contents, weights = toxic.pickle.loads(toxic.fit(before, table(spark, sf_dir, "labels")))
            distance, judged = toxic.Distance(*contents), set()
            for i, text in given:
                z = sum(a * b for a, b in zip([*distance.features(toxic.windows(text)), 1.0], weights, strict=True))
                if 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) < toxic.THRESHOLD:
                    judged.add(i)
            assert sorted(kept[name]) == sorted(r for r in given if r[0] in judged) and len(given) > len(judged) > 0.8 * len(given)
        elif name == "line_dedup":
            assert sorted(kept[name]) == sorted((i, t) for i, _, _, t in lines(given))
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "ngram_join":
            first = {i for (i, cls, _) in classes([r for r in given if grams(r[1])]) if i == cls} | {i for i, t in given if not grams(t)}
            assert sorted(kept[name]) == sorted(r for r in given if r[0] in first)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            short = [r for r in given if len(r[1] or "") < 2500]
            bad = {i for i, _ in leaks(short, items)}
            assert sorted(r for r in kept[name] if len(r[1] or "") < 2500) == sorted(r for r in short if r[0] not in bad)
        else:
            sources = {r.doc_id: r.source for r in before.collect()}
            rows = docs.collect()
            everything = {r.doc_id: r for r in c.mix(before).collect()}
            hold(everything.values(), sources)
            assert {(r.doc_id, r.taken, r.copies) for r in rows} == {(r.doc_id, r.taken, r.copies) for r in everything.values() if r.copies}


def test_run(spark, sf_dir):
    done = c.run(spark, sf_dir)
    assert 0 < done.count() < table(spark, sf_dir, "documents").count()
    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "mixing"]
    assert c.ORACLE_SQL is None


def test_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_odd_rows_and_names(spark, sf_dir):
    """Nulls in every column, repeated rows, clashing names: every stage takes them and keeps the columns."""
    text = "\n".join(f"a line of plain words that is long enough, number {k}" for k in range(6))
    rows = [(1, text, "en", "web", 1, 7), (1, text, "en", "web", 1, 7), (2, text + " more", None, None, None, 8), (None, None, None, None, None, None), (None, "", "x", "y", 0, 9), (3, "word " * 30000, "en", "web", 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, r int").withColumn("d", F.lit(1)).withColumn("leak", F.lit(2)).withColumn("_th", F.lit(3))
    names = docs.columns
    for k, (_, stage) in enumerate(c.STAGES):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns[: len(names)] == names and (k == 4 or docs.columns == names)
        assert {(r.d, r.leak, r._th) for r in docs.collect()} == {(1, 2, 3)}
