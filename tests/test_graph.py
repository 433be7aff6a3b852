"""Graph building, walks against plain traversals, communities, two-stage search."""

import random

from braidwork.operators import graph

DOC = "row_id bigint, document_id string, title string, text string, sentences array<string>, entities map<string,struct<type:string,lemma:string,mentions:array<struct<id:string,trigger_word:string,text:string,name:string,sent_id:int,sentence_id:int,token_id:int,offset:array<int>>>>>, relations map<string,array<array<string>>>"


def documents(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(12)]
    rows = []
    for i in range(8):
        own = rng.sample(nodes, 3)
        ents = {e: ("T", None, [(None, e.upper(), None, None, 0, None, None, None)]) for e in own}
        rels = {r: [[rng.choice(nodes), rng.choice(nodes)] for _ in range(4)] + [["bad"], None] for r in ("A", "B")}
        rows.append((i, f"d{i}", "t", "N1 causes A n2", None, ents, rels))
    rows.append((99, "none", None, None, None, None, None))
    docs = spark.createDataFrame(rows, DOC)
    order = {r.row_id: (r.e, r.r) for r in docs.selectExpr("row_id", "map_keys(entities) AS e", "map_keys(relations) AS r").collect()}  # as Spark stores the maps
    rows = [(*r[:5], r[5] and {k: r[5][k] for k in order[r[0]][0]}, r[6] and {k: r[6][k] for k in order[r[0]][1]}) for r in rows]
    return rows, docs.repartition(2)


def edge_list(rows):
    return [(p[0], r, p[1]) for row in rows for r, ps in (row[6] or {}).items() for p in ps if p and len(p) == 2]


def walk(seeds, edges, hops, most, allowed=None):
    frontier, seen, out = list(seeds), set(seeds), []
    for _ in range(hops):
        nxt = []
        for n in frontier:
            for h, r, t in edges:
                if h == n and (allowed is None or r in allowed):
                    out.append((h, r, t))
                    if t not in seen:
                        seen.add(t)
                        nxt.append(t)
        frontier = nxt
    return out[:most]


def test_walks(spark):
    rows, docs = documents(spark)
    edges = edge_list(rows)
    e = graph.gold_edges(docs)
    assert sorted((r.head, r.rel, r.tail) for r in e.collect()) == sorted(edges)
    for hops, most in ((1, 200), (2, 5), (3, 200)):
        got = {}
        for r in graph.neighbourhood(docs, e, hops, most).orderBy("rank").collect():
            got.setdefault(r.document_id, []).append((r.head, r.rel, r.tail))
        assert got == {r[1]: w for r in rows if r[5] and (w := walk(r[5], edges, hops, most))}
    hop = graph.neighbourhood(docs, e, 2, 200, hop_relations=["A"]).collect()
    assert {r.rel for r in hop} == {"A"}
    post = graph.neighbourhood(docs, e, 1, 3, post_relations=["B"]).collect()
    assert {r.rel for r in post} <= {"B"} and len(post) < 24
    once = {}
    for r in graph.distinct_neighbourhood(docs, e, 2, 1000).orderBy("rank").collect():
        once.setdefault(r.document_id, []).append((r.head, r.rel, r.tail))
    assert once == {r[1]: list(dict.fromkeys(w)) for r in rows if r[5] and (w := walk(r[5], edges, 2, 10**6))}


def test_scored(spark):
    rows, docs = documents(spark)
    got = graph.scored_triples(docs, graph.gold_edges(docs)).collect()
    assert got and all(r.rank >= 1 for r in got)
    for r in got:
        ents = next(x[5] for x in rows if x[1] == r.document_id)
        said = {"t", "n1", "causes", "a", "n2"}
        toks = {r.head, r.tail, r.rel.lower()} | {x for x in (r.head, r.tail) if x in ents}
        want = len(toks & said) + (r.head in ents) + (r.tail in ents) + 0.5 * (r.rel.lower() in said)
        assert r.score == want


def test_store(spark):
    e = spark.createDataFrame([(1, "a", "R", "b"), (2, "a", "R", "b"), (3, "a", None, "c"), (4, "", "R", "c"), (5, "c", " ", "a")], "edge_id bigint, head string, rel string, tail string")
    up = graph.upsert_edges(e)
    assert sorted((r.head, r.rel, r.tail, r.edge_id, r.copies) for r in up.collect()) == [("a", "R", "b", 1, 2), ("a", "RELATED", "c", 3, 1), ("c", "RELATED", "a", 5, 1)]
    nodes = spark.createDataFrame([("a", {"x": "1", "y": "1"})], "id string, attributes map<string,string>")
    store = graph.GraphStore(nodes, up.select("edge_id", "head", "rel", "tail")).upsert(nodes.selectExpr("id", "map('y', '2') AS attributes"), e)
    assert store.query("nodes").first().attributes == {"x": "1", "y": "2"}
    assert store.query("edges").count() == 3 and store.query("neighbors:a").count() == 2
    assert store.upsert(edges=e).query("edges").count() == 3
    try:
        store.query("what")
        raise AssertionError
    except ValueError:
        pass
    near = graph.neighbours(e, spark.createDataFrame([("a",)], "seed string"), incoming=True).collect()
    assert sorted((r.edge_id, r.neighbour) for r in near) == [(1, "b"), (2, "b"), (3, "c"), (5, "c")]


def test_stats_and_nodes(spark):
    rows, docs = documents(spark)
    s = graph.stats(docs, graph.gold_nodes(docs), graph.gold_edges(docs)).first()
    edges = edge_list(rows)
    nodes = {x for h, _, t in edges for x in (h, t)} | {k for r in rows for k in (r[5] or {})}
    assert (s.documents, s.triples, s.edges, s.nodes) == (9, len(edges), len(set(edges)), len(nodes))
    assert all(r.label == r.id.upper() for r in graph.gold_nodes(docs).collect())


def test_communities(spark):
    e = [(f"a{i}", f"a{j}", 3) for i in range(4) for j in range(i + 1, 4)] + [(f"b{i}", f"b{j}", 3) for i in range(4) for j in range(i + 1, 4)] + [("a0", "b0", 1)]
    got = {r.node: r.community for r in graph.communities(spark.createDataFrame(e, "a string, b string, weight bigint")).collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1 and len({got[f"b{i}"] for i in range(4)}) == 1 and got["a1"] != got["b1"]
    s = spark.createDataFrame([("A", "s1", 1), ("A", "s2", 2), ("B", "s3", 3), ("B", "s1", 9)], "community string, sentence_id string, pos bigint")
    v = spark.createDataFrame([("s1", [1.0, 0.0]), ("s2", [0.9, 0.1]), ("s3", [0.0, 1.0])], "sentence_id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [r.sentence_id for r in graph.two_stage(q, s, v, top_communities=1).orderBy("rank").collect()] == ["s1", "s2"]
    assert [r.sentence_id for r in graph.two_stage(q, s, v, delta_percent=100, lambda_percent=51).orderBy("rank").collect()] == ["s1", "s2"]
    w = graph.weighted_pairs(spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x")], "head string, tail string")).collect()
    assert [tuple(r) for r in w] == [("x", "y", 2)]
