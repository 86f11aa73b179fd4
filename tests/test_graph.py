"""Graphs of files, knowledge graphs, symbols, logs."""

import json

import pytest
from pyspark.sql import functions as F

from sparksift.operators import expand, extract, graph, knowledge, symbols
from sparksift.plans import engine
from sparksift.sources import files as sources
from sparksift.sources import logs
from sparksift.streaming import mutations


def rank(spark, ids, edges, personal=None):
    e = spark.createDataFrame(edges, "src string, dst string, weight double") if edges else spark.createDataFrame([], "src string, dst string, weight double")
    p = spark.createDataFrame(personal, "id string, weight double") if personal else None
    return {r.id: r["rank"] for r in graph.pagerank(spark.createDataFrame([(i,) for i in ids], "id string"), e, p, rounds=30).collect()}


def test_pagerank(spark):
    assert rank(spark, ["a"], []) == {"a": pytest.approx(1)}
    two = rank(spark, ["a", "b"], [("a", "b", 1.0)])
    assert two["b"] > two["a"] and sum(two.values()) == pytest.approx(1)
    cycle = rank(spark, "abcd", [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "a", 1.0)])
    assert sum(cycle.values()) == pytest.approx(1) and max(cycle.values()) - min(cycle.values()) < 1e-6
    dangling = rank(spark, "ab", [])
    assert dangling["a"] == pytest.approx(dangling["b"])
    loop = rank(spark, "ab", [("a", "a", 1.0), ("b", "a", 1.0), ("b", "zz", 9.0)])
    assert loop["a"] > loop["b"]
    assert rank(spark, "ab", [("a", "b", 1.0)], [("a", 1.0)])["a"] > two["a"]


def test_reference_edges(spark):
    defs = spark.createDataFrame([("f", "a"), ("_g", "a"), ("alone", "c")], "name string, file string")
    refs = spark.createDataFrame([("f", "b")] * 4 + [("f", "a"), ("_g", "b")], "name string, file string")
    got = {(r.src, r.dst): r.weight for r in graph.reference_edges(defs, refs).collect()}
    assert got == {("b", "a"): 2.0 + 1.0, ("c", "c"): 0.1}
    focus = {(r.src, r.dst): r.weight for r in graph.reference_edges(defs, refs, focus=["b"]).collect()}
    assert focus["b", "a"] == 100.0 + 5.0


TAGS = [(n, f"f{f}") for n in range(7) for f in range(n % 3, 12, 1 + n % 4)], [(n, f"f{f}") for n in range(1, 8) for f in range(0, 13, 1 + n % 5) for _ in range(1 + (n * f) % 3)]


@pytest.mark.parametrize("hot", [0, 20, 1000])
def test_edges_of_frequent_names_are_products_of_blocks(spark, monkeypatch, hot):
    defs, refs = (spark.createDataFrame(t, "name int, file string").withColumn("name", F.concat(F.lit("longName_"), "name")) for t in TAGS)
    names = {n for n, _ in TAGS[1]}
    want = {}
    for n, src in set(TAGS[1]):
        d = {f for m, f in TAGS[0] if m == n}
        w = max(1, int(10 * (0.1 if len(d) > 5 else 1) * TAGS[1].count((n, src)) ** 0.5 + 0.5))
        want |= {(src, dst): want.get((src, dst), 0) + w for dst in d if dst != src}
    for n, f in set(TAGS[0]):
        if n not in names:
            want[f, f] = want.get((f, f), 0) + 0.1
    for k, v in {"HOT": hot, "BLOCK": 5, "EXPANDED": 8}.items():
        monkeypatch.setattr(graph, k, v)
    assert {(r.src, r.dst): r.weight for r in graph.reference_edges(defs, refs).collect()} == pytest.approx(want)


@pytest.mark.parametrize("personal", [None, [("f1", 2.0), ("f4", 1.0)]])
def test_pagerank_through_names_needs_no_edges(spark, personal):
    defs, refs = (spark.createDataFrame(t, "name int, file string").withColumn("name", F.concat(F.lit("longName_"), "name")) for t in TAGS)
    nodes = spark.createDataFrame([(f"f{i}",) for i in range(11)], "id string")  # f11 and f12 are not known, f10 refers to little
    p = spark.createDataFrame(personal, "id string, weight double") if personal else None
    found = [{r.id: r["rank"] for r in graph.pagerank(nodes, g, p, rounds=6, tolerance=None).collect()} for g in (graph.reference_edges(defs, refs), graph.reference_factors(defs, refs))]
    assert found[1] == pytest.approx(found[0], abs=1e-12) and sum(found[0].values()) == pytest.approx(1)


SOURCE = {
    "src/app.ts": "import { getConfig } from './config';\nimport helper from '@/lib/helper';\nexport function initApp() { return getConfig(); }\n",
    "src/other.ts": "const { getConfig } = require('./config');\nfunction otherInit() {\n  getConfig();\n}\nfunction setupLogging() { getConfig(); }\n",
    "src/config.ts": "export function getConfig() {\n  return { a: 1 };\n}\n",
    "src/lib/helper.ts": "export default class Helper {\n  run() { return 1; }\n}\n",
    "pkg/a.py": "from pkg.b import work\n\ndef main():\n    work()\n\nclass Task:\n    def go(self):\n        return main()\n",
    "pkg/b.py": "def work():\n    return 1\n",
}


@pytest.fixture(scope="module")
def repo(spark):
    rows = [(p, b, "python" if p.endswith(".py") else "typescript") for p, b in SOURCE.items()]
    files = spark.createDataFrame(rows, "path string, body string, lang string")
    r = engine.Repository.of(files, [("@", "src")])
    return engine.Repository(files, r.tags.cache(), r.calls.cache(), r.imports.cache())


def test_imports(repo):
    got = {(r.src, r.dst) for r in repo.imports.collect()}
    assert {("src/app.ts", "src/config.ts"), ("src/app.ts", "src/lib/helper.ts"), ("src/other.ts", "src/config.ts")} <= got


def test_callers_and_neighbours(repo):
    assert {r.caller for r in symbols.callers(repo.calls, "getConfig").collect()} == {"initApp", "otherInit", "setupLogging"}
    near = {(r.file, r.edge_type) for r in graph.call_neighbours(repo.calls, extract.functions(repo.tags), ["src/config.ts"]).collect()}
    assert ("src/app.ts", "called_by") in near and ("src/other.ts", "called_by") in near
    lists = {r.name: r for r in graph.call_lists(repo.calls, extract.functions(repo.tags)).collect()}
    assert lists["getConfig"].called_by == ["initApp", "otherInit", "setupLogging"]


def test_symbols(repo):
    hits = symbols.search(repo.tags, "CONFIG").collect()
    assert hits[0].kind == "def" and hits[0].file == "src/config.ts"
    assert {r.kind for r in symbols.search(repo.tags, "config", defs=False).collect()} == {"ref"}
    best = engine.search(repo, "resolve", "getconfig", context="src/app.ts").collect()
    assert (best[0].file, best[0].score, best[0].best) == ("src/config.ts", 90, True)
    assert {r.caller for r in engine.search(repo, "callers", "work").collect()} == {"main"}
    code = engine.search(repo, "code", "getConfig").collect()
    assert "src/config.ts" in {r.file for r in code} and code[0].score >= code[-1].score
    lines = symbols.search_lines(repo.files, "getconfig").collect()
    assert lines[0].kind == "def" and lines[0].name == "getConfig"


def test_tags(repo):
    py = {(r.name, r.kind) for r in repo.tags.where("file = 'pkg/a.py'").collect()}
    assert {("main", "def"), ("Task", "def"), ("go", "def"), ("work", "ref"), ("main", "ref")} <= py


def test_map_and_reading(repo):
    m = engine.repo_map(repo, tokens=200, idents=["getConfig"])
    assert m["basis"] == "references" and m["text"].splitlines()[0].startswith("src/config.ts")
    assert len(engine.repo_map(repo, tokens=10)["text"]) <= 40
    out = engine.intent_read(repo, "initApp getConfig", ["src/app.ts"])
    assert out["ranked"][0] == "src/app.ts" and "src/config.ts" in out["ranked"] and "@src/app.ts" in out["text"]
    assert engine.intent_read(repo, "initApp", ["src/app.ts"], structural=True)["ranked"]
    many = engine.read_many(repo.files, ["src/config.ts", "nope.ts"])
    assert "getConfig" in many["text"] and "error" in many["text"] and many["plan"].successes == 1
    with pytest.raises(ValueError):
        engine.read_many(repo.files, ["../x"])
    assert engine.annotate(repo, "src/config.ts")["imported_by"] == ["src/app.ts", "src/other.ts"]


def test_expansion(repo):
    got = {r.file: r.phase for r in engine.expanded(repo, ["src/app.ts"], "the getConfig function").collect()}
    assert got["src/app.ts"] == 0 and got["src/config.ts"] == 1 and "src/lib/helper.ts" in got
    assert expand.probe_identifiers("the function handleUserLogin") == ["handleuserlogin", "user", "login"]
    assert expand.hypothetical("the and or") == ("the and or", False)
    text, applied = expand.hypothetical("handle_user_login function")
    assert applied and "handleUserLogin" in text
    assert expand.query_pattern("database config") == "config" and not expand.hypothetical("xy")[1]


def test_personalization_and_import_rank(spark):
    files = spark.createDataFrame([("core.ts",), ("plugin.ts",)], "file string")
    imports = spark.createDataFrame([("plugin.ts", "core.ts")], "src string, dst string")
    got = {r.file: r["rank"] for r in graph.import_ranks(files, imports, focus=["plugin.ts"]).collect()}
    assert got == {"core.ts": 1.0, "plugin.ts": 2.0}
    p = {r.file: r.weight for r in graph.personalization(files, focus=["core.ts"], mentioned=["plugin"]).collect()}
    assert p == {"core.ts": 50.0, "plugin.ts": 50.0}


def test_dependents_and_cochange(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "file string, depends_on string")
    assert {r.file for r in graph.dependents(deps, ["c"]).collect()} == {"a", "b"}
    commits = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x"), (3, "z")], "commit_id int, path string")
    assert [(r.path, r["count"], round(r.correlation, 3)) for r in graph.co_changes(commits, "x").collect()] == [("y", 2, 0.667), ("z", 1, 0.333)]


def test_knowledge(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "label": "Auth", "source_file": "a.ts", "community": 1}, {"id": "b", "label": "Base", "source_file": "b.ts", "community": 1}, {"id": "c", "label": "c.ts", "source_file": "c.ts", "community": 2}], "links": [{"source": "a", "target": "b", "relation": "calls", "confidence_score": 0.9}, {"source": "c", "target": "a", "relation": "uses", "confidence_score": 0.5}]}
    (tmp_path / "graph.json").write_text(json.dumps(doc))
    nodes, links = logs.knowledge_graph(spark, str(tmp_path / "graph.json"))
    assert {r.id: r.degree for r in knowledge.degrees(links).collect()} == {"a": 2, "b": 1, "c": 1}
    assert [r.id for r in knowledge.god_nodes(nodes, links).collect()] == ["a", "b"]
    assert [(r.path, r.relation) for r in knowledge.related_files(nodes, links, "a.ts").collect()] == [("b.ts", "calls"), ("c.ts", "uses")]
    assert {r.id: r.distance for r in knowledge.within(nodes, links, ["b"], 2).collect()} == {"b": 0, "a": 1, "c": 2}
    assert [r.id for r in knowledge.by_label(nodes, "auth").collect()] == ["a"]
    assert {r.community: r.files for r in knowledge.community_members(nodes).collect()} == {1: ["a.ts", "b.ts"], 2: ["c.ts"]}
    scored = spark.createDataFrame([("a.ts", 1.0)], "file string, score double")
    assert knowledge.boosted(scored, knowledge.file_centrality(nodes, links)).first().score == pytest.approx(1.02)


def test_log_and_stream(spark, tmp_path):
    lines = [
        {"type": "co_change", "data": {"from": "a.ts:login", "to": "b.ts", "confidence": 0.4}, "timestamp": 1_700_000_000_000},
        {"type": "co_change", "data": {"from": "a.ts", "to": "b.ts", "confidence": 0.8}, "timestamp": 1_700_000_100_000},
        {"type": "breakage", "data": {"from": "c.ts", "to": "d.ts"}, "timestamp": 1_600_000_000_000},
    ]
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "x.json").write_text("\n".join([json.dumps(x) for x in lines] + ["{broken"]))
    events = logs.mutations(spark, str(folder))
    recent = logs.fresh(events, "2023-11-15 00:00:00")
    assert [(r.src, r.dst, r.confidence) for r in logs.strongest(recent).collect()] == [("a.ts", "b.ts", 0.8)]
    assert {r.id for r in logs.neighbours(recent, "b.ts").collect()} == {"a.ts"}
    mutations.run_once(mutations.strongest(mutations.read(spark, str(folder))), "edges", str(tmp_path / "state"))
    assert {(r.src, r.confidence) for r in spark.sql("select * from edges").collect()} == {("a.ts:login", 0.4), ("a.ts", 0.8), ("c.ts", 1.0)}
    mutations.run_once(mutations.first_seen(mutations.read(spark, str(folder))), "firsts", str(tmp_path / "state2"), "append")
    assert spark.sql("select count(*) n from firsts").first().n == 3


def test_sources(spark, tmp_path):
    for p, b in {"src/a.ts": "a", "src/b.gen.ts": "b", "node_modules/x.js": "x", ".hidden/y.py": "y", "doc.txt": "t", "keep.gen.ts": "k"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(b)
    rules = sources.parse_rules("# c\n*.gen.ts\n!keep.gen.ts\n")
    found = sources.scan(spark, str(tmp_path), rules)
    assert [r.path for r in found.collect()] == ["keep.gen.ts", "src/a.ts"]
    assert [r.path for r in sources.scan(spark, str(tmp_path), max_files=1).collect()] == ["keep.gen.ts"]
    one = sources.listing(found, "src").first()
    assert (one.path, one.count_before_cap, one.capped) == ("src/a.ts", 1, False)
    assert [r.path for r in sources.naming(found, ["KEEP"]).collect()] == ["keep.gen.ts"]
    lines = spark.createDataFrame([("1\n2\n3\n4",)], "b string").select(sources.line_slice(F.col("b"), 2, 2).alias("x")).first().x
    assert lines == "2\n3"
    imp = spark.createDataFrame([("package.json",), (".github/workflows/ci.yml",), ("src/package.json",)], "p string")
    assert [r.y for r in imp.select(sources.important(F.col("p")).alias("y")).collect()] == [True, True, False]
    assert [tuple(r) for r in sources.aliases(spark, '{"compilerOptions": {"paths": {"@/*": ["./src/*"], "x": ["y"]}}}').collect()] == [("@", "src")]


def test_ignore_rules_fold(spark):
    rules = sources.parse_rules("build/\n/top.ts\nsub/*.js\n")
    paths = spark.createDataFrame([("build/a.ts",), ("x/build/a.ts",), ("build.ts",), ("top.ts",), ("x/top.ts",), ("sub/a.js",), ("x/sub/a.js",)], "path string")
    assert [r.ignored for r in sources.ignored(paths, rules).collect()] == [True, True, False, True, False, True, False]


def test_whole_knowledge_graph(spark, tmp_path):
    """The queries over all links, not those of a third of the orders, by force."""
    from sparksift.plans import catalogue

    n, orders = 12, [(k, k * 5 % 12 + 1, "1-URGENT", float(k)) for k in range(1, 31)]
    spark.createDataFrame([(i, f"Customer#{i}", i % 3) for i in range(1, n + 1)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    links = {(c, k * 7 % n + 1) for k, c, _, _ in orders}
    near = {}
    for a, b in links | {(b, a) for a, b in links}:
        near.setdefault(a, set()).add(b)
    run = lambda q: catalogue.QUERIES[q](spark, str(tmp_path)).collect()
    degree = {a: len(b - {a}) for a, b in near.items() if b - {a}}
    assert {r.id: r.degree for r in run("kg_degree")} == degree
    assert run("kg_stats")[0].links == len(links)
    assert [(r.id, r.degree) for r in run("kg_god_nodes")] == sorted(degree.items(), key=lambda x: (-x[1], x[0]))[:10]
    distance = dict.fromkeys((1, 2, 3), 0)
    for d in (1, 2, 3):
        distance |= {b: d for a in list(distance) for b in near.get(a, ()) if b not in distance}
    assert {r.id: r.distance for r in run("kg_bfs_depth3")} == distance


def test_whole_tags(spark, tmp_path):
    """The queries over the lines of all parts, by force."""
    from sparksift.plans import catalogue

    lines = [(o, o * (i + 3) % 11, (o + i) % 5 + 1, i + 1) for o in range(1, 40) for i in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"blue {p}", p) for p in range(11)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda q: catalogue.QUERIES[q](spark, str(tmp_path)).collect()
    counts = {f: (sum(x == f and n == 1 for _, _, x, n in lines), sum(x == f and n > 1 for _, _, x, n in lines)) for f in range(1, 6)}
    assert {r.file: (r.defs, r.refs) for r in run("tag_counts")} == counts
    defs, refs = ({(p, f) for _, p, f, n in lines if (n == 1) == first} for first in (True, False))
    loops = {(f, f) for p, f in defs if p not in {q for q, _ in refs}}
    assert {(r.src, r.dst) for r in run("def_ref_edges")} == {(g, f) for p, f in defs for q, g in refs if p == q and f != g} | loops
