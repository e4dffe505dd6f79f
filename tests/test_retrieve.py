"""Plans over the pool: each text is read once, with the same scores."""

from pyspark.sql import functions as F

from veldra.functions import text as T
from veldra.operators import asking as A
from veldra.plans import answer as W, retrieve as plans

VECTOR = "id string, vector array<double>, sparse map<int,double>, doc_year string, section string, source_file string, keywords array<string>, filename_tokens array<string>"


def inputs(spark, n=40):
    vector = lambda i: [float(i % 5 + 1), float(i % 7), 1.0]
    base = spark.createDataFrame([(f"c{i:02}", vector(i), {i % 4: 1.0}, "2018", "s", f"f{i % 3}", None, None) for i in range(n)], VECTOR)
    units = spark.createDataFrame([(f"u{i}", 0, vector(i), {i % 4: 1.0}, ("2018", None, None, None, None)) for i in range(5)], f"unit_id string, sub int, vector array<double>, sparse map<int,double>, hints {A.HINTS}")
    questions = spark.createDataFrame([(f"u{i}", "buyer delayed payment" if i else None) for i in range(5)], "unit_id string, question string")
    chunks = spark.createDataFrame([(f"c{i:02}", i, "the buyer delayed payment" if i % 2 else "supplier", f"f{i % 3}") for i in range(n)], "chunk_id string, chunk_index int, text string, source_file string")
    none = {"section": "string", "page_no": "int", "page_label": "string", "is_table": "boolean", "chunk_year": "array<string>", "doc_year": "string", "doc_id": "string", "summary": "string"}
    return base, units, questions, chunks.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))


def test_words_are_read_once_for_each_text(spark):
    base, units, questions, chunks = inputs(spark)
    plan = plans.ranked(base, units, questions, chunks).filter("boosted >= 0.3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_scores_of_pairs_are_those_of_their_words(spark):
    texts = [None, "", "delayed buyer x_1", "the of and", "Buyer, buyer PAYMENT", "payment of the buyer", "a b", "x_1 delayed"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    plain = 10 * T.overlap(T.answer_tokens(F.coalesce("a", F.lit(""))), T.answer_tokens(F.coalesce("b", F.lit("")))) - 5
    got = pairs.select(plain.alias("x"), plans.lexical_logit(plans.word_list(F.col("a")), plans.word_list(F.col("b"))).alias("y")).collect()
    assert all(r.x == r.y for r in got) and len({r.x for r in got}) > 2
    assert spark.range(1).select(plans.lexical_logit(F.lit(None).cast("string"), F.lit("x"))).first()[0] == -5


def test_ask_ranks_once(spark):
    base, units, questions, chunks = inputs(spark)
    answers = W.ask(base, units, questions, chunks)
    assert "exp(" not in answers._jdf.queryExecution().optimizedPlan().toString().lower()  # the sigmoid of the ranking
    assert {r.unit_id for r in answers.collect()} == {f"u{i}" for i in range(5)}
