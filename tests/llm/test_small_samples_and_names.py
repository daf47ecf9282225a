"""Filters on small labelled samples, on repeated labelled ids, and with columns of any name."""

from pyspark.sql import functions as F

from textloom.llm import benchmark_decontam, language_id, near_dedup, source_mixing, substring_dedup, toxicity

SF = "/root/testdata/sf0.01"


def test_a_small_sample_keeps_its_clean_rows(spark):
    every, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for n in (20, 60, 120):
        docs = every.where(F.col("doc_id") < n)
        clean = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi").count()
        kept = toxicity.drop_toxic(docs, labels)
        assert kept.join(labels.where("toxic = 0"), "doc_id", "left_semi").count() >= 0.95 * clean
        assert kept.count() >= 0.85 * docs.count()  # about a seventh of the labelled rows are toxic


def test_held_out_figures(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    told = toxicity.scored(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    rows = told.where("pmod(crc32(cast(doc_id as string)), 4) = 2").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_a_labelled_id_that_repeats_is_learned_from_once(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = labels.where("toxic = 1 and pmod(crc32(cast(doc_id as string)), 4) <> 2").orderBy("doc_id").first().doc_id
    many = docs.union(docs.where(F.col("doc_id") == one).crossJoin(spark.range(5000)).drop("id"))
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda d, y, x: seen.append(len(d)))
    toxicity.fit(docs, labels)
    toxicity.fit(many, labels)
    assert seen[0] == seen[1] <= toxicity.MOST_TOXIC + toxicity.MOST_CLEAN


def test_without_both_kinds_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more", "en") for i in range(40)], "doc_id long, text string, lang string")
    for toxic in ([], [3], list(range(40))):
        labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(40)], "doc_id long, toxic int")
        assert toxicity.drop_toxic(docs, labels).count() == 40


ODD = ("a.b", "`tick`", "two words", "Extra", "extra", "a.b.c", "sélect", "count")


def test_columns_of_any_name_are_carried(spark):
    rows = [(i, f"text number {i} of several words that differ here {i * i}", "en", "s", 5, *(f"{c}{i}" for c in ODD)) for i in range(12)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"x{i} string" for i in range(len(ODD)))).toDF(*names)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this kind at all, whatever else")], "item_id long, text string")
    model = toxicity.fit(df.select("doc_id", "text", "lang"), labels)
    every = {
        "toxicity": toxicity.drop_toxic(df, labels),
        "near": near_dedup.drop_near_duplicates(df),
        "repeats": substring_dedup.drop_repeats(df),
        "bench": benchmark_decontam.drop_contaminated(df, bench),
        "scored": toxicity.scored(df, model),
        "language": language_id.predicted(df, None),
        "mixed": source_mixing.mix(df),
    }
    for what, out in every.items():
        assert out.columns[: len(names)] == names, what
        got = {r[0]: r[5 : 5 + len(ODD)] for r in out.collect()}
        assert got and all(v == tuple(f"{c}{i}" for c in ODD) for i, v in got.items()), what


def test_rows_that_repeat_go_and_others_stay(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text of the same id"), (None, "no id"), (None, "no id"), (None, None), (2, None), (2, None), (3, "a b c d e f"), (4, "x")]
    got = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "a b c d e f"), (1, "quite another text of the same id"), (None, "no id"), (None, None), (2, None), (4, "x")], key=repr)
