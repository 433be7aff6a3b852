"""Line contexts where IRIs stand on many lines: the same as by brute force, without a row per document and hit."""

from braidwork.operators import ontology

LINKS = "named_struct('by_entity', map_from_arrays(transform(us, (u, i) -> concat('e', i)), transform(us, u -> named_struct('candidates', array(named_struct('concept_uri', u)))))) AS ontology_links"


def brute(uris, lines, index, around, most):
    at = {}
    for k, u in enumerate(uris):
        for hit in (h for x, h in index if x == u):
            for line in range(max(0, hit - around), hit + around + 1):
                if line in lines:
                    at[line] = min(at.get(line, (k, hit)), (k, hit))
    best = [lines[x] for x in sorted(at, key=lambda x: (at[x], x))[:most]]
    good = [t for t in best if "label" in t]
    return "\n".join(good or best)


def test_orders_of_iris(spark):
    lines = {i: f"l{i}" + (" label" if i % 7 == 0 else "") for i in range(120) if i % 11}
    index = [(f"u{k}", h) for k in range(6) for h in range(k, 120, 3 * k + 2) if h in lines or k % 2]  # hits on lost lines too
    docs = [(f"d{j}", [f"u{(j * a + b) % 7}" for a, b in ((1, 0), (3, 1), (5, 4))]) for j in range(20)] + [("none", ["u9"])]
    d = spark.createDataFrame(docs, "document_id string, us array<string>").selectExpr("document_id", LINKS)
    ls, ix = spark.createDataFrame(sorted(lines.items()), "line int, text string"), spark.createDataFrame(index, "uri string, line int")
    for most in (3, 20, 200):
        got = {r.document_id: r.context for r in ontology.line_context(d, ls, ix, most=most).collect()}
        assert got == {k: brute(us, lines, index, 2, most) or ontology.NO_LINES for k, us in docs}


def test_hits_are_not_multiplied_by_documents(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    d = spark.range(1500).selectExpr("concat('d', id) AS document_id", "array('a', 'b') AS us").selectExpr("document_id", LINKS)
    ls = spark.range(1500).selectExpr("id AS line", "concat('label ', id) AS text")
    ix = spark.range(1500).selectExpr("if(id % 2 = 0, 'a', 'b') AS uri", "id AS line")
    before = written()
    assert ontology.line_context(d, ls, ix).selectExpr("sum(size(split(context, '\\n')))").first()[0] == 1500 * 200
    assert written() - before < 3_000_000
