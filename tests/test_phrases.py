from weavegrid.operators import retrieval, sparse


def test_queries_of_any_number_of_words_equal_contains(spark):
    texts = ["One two three four five six seven eight", "xone two", "two  three", "", None, "SEVEN", "one two three four five sixth", "un été"]
    asked = ["one", "One two", "two three four", "one two three four", "one two three four five", "one two three four five six", "one two three four five six seven", "ne two", "", None, "été", " three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]) for r in sparse.phrase_matches(docs, queries).collect()}
    assert got == {(i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if q is not None and t is not None and q.lower() in t.lower()}


def test_fallback_finds_short_queries(spark):
    nodes = spark.createDataFrame([("CWE-1", "Buffer overflow", "Base"), ("CWE-2", "race", "Base")], "id string, name string, type string")
    asked = spark.createDataFrame([("q", "overflow")], "query_id string, text string")
    assert [(r["query_id"], r["node"]) for r in retrieval.substring_fallback(asked, nodes, 5).collect()] == [("q", "CWE-1")]
