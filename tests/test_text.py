from pyspark.sql import functions as F

from termloom.functions import text

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "disabled": "disabl", "matting": "mat", "mating": "mate",
    "meeting": "meet", "milling": "mill", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "feudalism": "feudal",
    "hopefulness": "hope", "sensibiliti": "sensibl", "electriciti": "electr", "goodness": "good", "airliner": "airlin", "replacement": "replac", "adoption": "adopt",
    "homologou": "homolog", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    # y is always a consonant
    "crying": "crying", "typing": "typing", "typed": "typed", "encryption": "encryption", "encrypted": "encrypt", "analysis": "analysi", "latency": "latenc", "is": "is",
}


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == STEMS


def test_tokenize_edges(spark):
    given = [("The Quick Brown Fox",), ("Kubernetes is a container-orchestration system",), ("",), (None,), ("  ...!!! ",), ("HTTP/3 café",)]
    rows = spark.createDataFrame(given, "t string").select(text.tokenize(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [["quick", "brown", "fox"], ["kubernet", "contain", "orchestr", "system"], [], [], [], ["caf"]]


def test_query_terms_keep_first_order(spark):
    row = spark.createDataFrame([("distributed distributed systems",)], "t string").select(text.query_terms(F.col("t")).alias("x")).first()
    assert row.x == ["distribut", "system"]


def test_term_counts(spark):
    docs = spark.createDataFrame([("a", "Distributed systems are distributed across nodes", 1), ("b", None, 2), ("c", "", 3)], "doc_key string, text string, token int")
    rows = {(r.doc_key, r.term): r.tf for r in text.term_counts(docs, "doc_key", "text").collect()}
    assert rows == {("a", "distribut"): 2, ("a", "system"): 1, ("a", "node"): 1}


def test_stop_words_file(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text("fox\n")
    assert "fox" in text.stop_words(str(path)) and "q" in text.stop_words() and "docker" not in text.stop_words()


def test_round4_halves_go_up(spark):
    row = spark.range(1).select(text.round4(F.lit(0.00005)).alias("a"), text.round4(F.lit(-0.00005)).alias("b"), text.round4(F.lit(1)).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.0001, 0.0, 1.0)
