"""Turtle, concepts, search, links, sub-ontologies, line context, chunks."""

from pyspark.sql import functions as F

from braidwork.operators import chunks, ontology
from braidwork.sources import turtle

TTL = """@prefix ex: <http://x/#> .
# a comment
ex:Pump a owl:Class ; rdfs:label "Pump"@en ; skos:altLabel "water pump" , "feeder" ; rdfs:comment "Moves \\"fluids\\"." .
ex:Seal a owl:Class ; skos:prefLabel "Seal ring" ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty ex:part ] .
<http://x/#Valve> a owl:Class .
ex:part a rdf:Property ; rdfs:label "part of" ; rdfs:domain ex:Pump , ex:Seal ; rdfs:range ex:Seal .
ex:any a rdf:Property ; rdfs:range ex:Valve .
ex:free a rdf:Property .
ex:num ex:value 4.5 , true , '''long
text''' , "12"^^xsd:int .
ex:broken [[ ;; .
ex:cut a owl:Cl"""
X = "http://x/#"


def rdf(spark):
    return turtle.triples(spark.createDataFrame([(1, TTL), (2, None), (3, "")], "id int, t string"), "t")


def test_turtle(spark):
    got = {(r.s.replace(X, ""), r.p.rpartition("#")[2], r.o.replace(X, "")) for r in rdf(spark).collect()}
    assert {("Pump", "label", "Pump"), ("Pump", "altLabel", "water pump"), ("Pump", "altLabel", "feeder"), ("Pump", "comment", 'Moves "fluids".'), ("num", "value", "long\ntext"), ("num", "value", "12"), ("num", "value", "4.5")} <= got
    assert ("cut", "type", "Cl") not in got and any(s.startswith("_:") for s, _, _ in got)
    c = {r.uri.replace(X, ""): r for r in turtle.concepts(rdf(spark)).collect()}
    assert {k: v.label for k, v in c.items()} == {"Pump": "Pump", "Seal": "Seal ring", "Valve": "Valve"}
    assert c["Pump"].aliases == ["feeder", "water pump"] and c["Valve"].description is None


def test_files_and_lines(spark, tmp_path):
    p = tmp_path / "o.ttl"
    p.write_text(TTL)
    assert turtle.load(spark, str(p)).count() == rdf(spark).count()
    assert turtle.cached(spark, str(p)) is turtle.cached(spark, str(p))
    lines = turtle.lines(spark.createDataFrame([(1, "a <u:1>\nb\nc <u:2> <u:1>")], "id int, t string"), "id", "t")
    assert sorted((r.uri, r.line) for r in turtle.line_index(lines, "id").collect()) == [("u:1", 0), ("u:1", 2), ("u:2", 2)]


def test_ratios():
    assert ontology.ratio("abcd", "abxd") == 75.0 and ontology.partial_ratio("pump", "the water pump") == 100.0
    assert ontology.token_ratio("pump water", "water pump") == 100.0
    assert ontology.weighted_ratio("pump", "pump") == 100.0 and ontology.weighted_ratio("", "x") == 0.0
    assert ontology.weighted_ratio("water pump failure", "pump") == 90.0 and ontology.weighted_ratio("x" * 50 + " pump", "pump") == 60.0


def test_search_and_evidence(spark):
    c = turtle.concepts(rdf(spark))
    q = spark.createDataFrame([(1, "water pump"), (2, ""), (3, "fluids")], "query_id int, query string")
    got = ontology.search(q, c, 2).collect()
    assert [(r.query_id, r.label, r["rank"]) for r in got if r.query_id == 1][0] == (1, "Pump", 1)
    assert {r.query_id for r in got} == {1, 3} and [r for r in got if r.query_id == 3][0].score <= 0.9
    e = {r.document_id.replace(X, ""): r.text for r in ontology.evidence(ontology.search(q, c, 3), c).collect()}
    assert e["Pump"] == 'Pump: Moves "fluids".' and e["Valve"] == "Valve"


DOC = f"document_id string, sentences array<string>, entities map<string,struct<type:string,mentions:array<struct<id:string,trigger_word:string,text:string,name:string,sent_id:int,sentence_id:int>>>>, ontology_links struct<by_entity:map<string,struct<candidates:array<{ontology.CANDIDATE}>,selected:{ontology.CANDIDATE}>>>"


def docs(spark):
    c = lambda uri, kind=None, s=0.5: (kind, uri, "l", s, "m", None)
    rows = [
        ("d1", ["the pump broke", "x"], {"e1": ("Break", [(None, "pump", None, None, 0, None)]), "e2": (None, None)}, ({"e1": ([c(X + "Pump"), None, c(X + "Seal", "class"), c(X + "part", "property"), c("", "class")], c(X + "Seal"))},)),
        ("d2", None, {}, ({},)),
        ("d3", None, None, None),
    ]
    return spark.createDataFrame(rows, DOC)


def test_sub_ontology(spark):
    d, r = docs(spark), rdf(spark)
    t = ontology.targets(d)
    assert sorted((x.document_id, x.kind, x.uri.replace(X, "")) for x in t.collect()) == [("d1", "class", "Pump"), ("d1", "class", "Seal")]
    assert [x.uri for x in ontology.targets(d, "selected").collect()] == [X + "Seal"]
    p = ontology.properties(r, t).collect()
    assert [(x.uri, x.domains, x.ranges, x.kept_because) for x in p] == [(X + "part", [X + "Pump", X + "Seal"], [X + "Seal"], "domain_and_range_match")]
    assert [x.uri for x in ontology.properties(r, t, unrestricted=True).orderBy("uri").collect()] == [X + "free", X + "part"]
    assert ontology.properties(r, t, unrestricted=True, most=1).first().kept_because == "no_constraints"
    valve = t.withColumn("uri", F.lit(X + "Valve"))
    assert ontology.properties(r, valve).first().kept_because == "range_match_domain_open"
    labels = turtle.concepts(r).select("uri", "label")
    f = ontology.fragment(ontology.properties(r, t), t, labels)
    assert f.count() == 9
    ttl = ontology.turtle(f).first().ttl
    assert len(list(turtle.parse(ttl))) == 9 and '"Seal ring"' in ttl


def test_links(spark):
    d = docs(spark)
    e = ontology.entity_texts(d)
    texts = {r.entity_id: r.text for r in e.collect()}
    assert texts == {"e1": "event trigger: pump ; event type: Break ; context: the pump broke", "e2": ""}
    linked = ontology.link(e, turtle.concepts(rdf(spark)), least=0.1)
    assert [(r.entity_id, r.label, r["rank"]) for r in linked.collect()][0] == ("e1", "Pump", 1)
    assert ontology.link(e, turtle.concepts(rdf(spark)), least=0.99).count() == 0
    nested = ontology.links_v1(linked)
    m = nested.first().ontology_links
    assert m.by_entity["e1"].candidates[0].label == "Pump" and m._meta.schema_version == "1.0"
    again = ontology.links_v1(linked)
    low = ontology.downgrade(again)
    up = ontology.upgrade(low).first().ontology_links.by_entity["e1"].candidates
    assert [c.concept_uri for c in up] == [c.concept_uri for c in m.by_entity["e1"].candidates]
    assert {r.note for r in ontology.empty_links(d).collect()} == {"not_implemented"}


def test_line_context(spark):
    d = docs(spark)
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(["l0", f"<{X}Pump> label", "l2 comment", "l3", "l4", f"<{X}Seal>", "l6"])], "line int, text string")
    index = spark.createDataFrame([(X + "Pump", 1), (X + "Seal", 5)], "uri string, line int")
    got = {r.document_id: r.context for r in ontology.line_context(d, lines, index).collect()}
    assert got == {"d1": f"<{X}Pump> label\nl2 comment", "d2": ontology.NO_LINKS, "d3": ontology.NO_LINKS}
    assert ontology.line_context(d, lines, index.limit(0)).where("document_id = 'd1'").first().context == ontology.NO_LINES
    plain = lines.withColumn("text", F.concat(F.lit("t"), "line"))
    assert ontology.line_context(d, plain, index).where("document_id = 'd1'").first().context == "t0\nt1\nt2\nt3\nt4\nt5\nt6"


def test_chunks(spark):
    t = spark.createDataFrame([(1, "1 2 3 4 5"), (2, ""), (3, None)], "id int, text string")
    w = lambda size, over: [[" ".join(x) for x in r.w] for r in t.orderBy("id").select(chunks.windows(chunks.words("text"), size, over).alias("w")).collect()]
    assert w(3, 1) == [["1 2 3", "3 4 5", "5"], [], []] and w(2, 2)[0] == ["1 2", "2 3", "3 4", "4 5", "5"]
    h = chunks.hierarchy(t, "id", "text", (3, 2), 1).orderBy("chunk").collect()
    assert [(r.chunk, r.level, r.parent, r.text) for r in h][:4] == [(0, 0, None, "1 2 3"), (1, 1, 0, "1 2"), (2, 1, 0, "2 3"), (3, 1, 0, "3")]
    lab = lambda s: spark.createDataFrame([(s,)], "s string").select(chunks.label("s").alias("x")).first().x
    assert lab("a <http://x/y#Z> b") == "y#Z" and lab("one two three four five six seven") == "one two three four five six" and lab(" ") == "ontology_chunk"
    assert chunks.whole(t.where("id = 1")).first().chunk_id == "1-c0"
    table = spark.createDataFrame([(1, None, "p"), (2, 1, "a"), (3, 1, "b"), (4, 77, "lost")], "chunk_id bigint, parent_id bigint, text string")
    hits = spark.createDataFrame([(9, 4, 1), (9, 3, 2), (9, 2, 3)], "q int, chunk_id bigint, rank int")
    assert [(r.chunk_id, r["rank"]) for r in chunks.merged(hits, table, "q").orderBy("rank").collect()] == [(4, 1), (1, 2)]
