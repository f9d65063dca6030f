"""What the queries' work grows with: plans and rounds, on small tables."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from lineagrid.functions import dax
from lineagrid.operators import graph as g
from lineagrid.operators import report
from lineagrid.plans.bridge import VIEWS, view
from lineagrid.sources import tmdl

SF = "/root/testdata/sf0.001"


def test_tables_of_projects_are_multiplied_after_projects_are_distinct(spark):
    own = spark.sql(VIEWS["b_table"], b_rel=view(spark, SF, "b_rel"), part=view(spark, SF, "part"))
    df = view(spark, SF, "b_table")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, own.collect()))
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {k: next(i for i, x in enumerate(plan) if k in x) for k in ("Join Cross", "Aggregate")}
    assert depth["Join Cross"] < depth["Aggregate"]


def test_seeds_walk_in_masks(spark):
    """A closure of 200 seeds, circles included, against a plain walk; 64 seeds share a row."""
    edges = [(f"n{i}", f"n{j}") for i in range(1, 200) for j in {i // 2, i // 3} if i != j] + [("n0", "n5"), ("n7", "leaf"), ("n9", "leaf"), ("n9", "n9")]
    e = spark.createDataFrame([("P", "s", a, b) for a, b in edges], "project_id string, snapshot_id string, source string, target string")
    names = [f"n{i}" for i in range(200)]
    seeds = spark.createDataFrame([("P", "s", n) for n in names], "project_id string, snapshot_id string, seed string")

    def plain(seed, to, limit=99, stop=()):
        at, depth, front = {seed: 0}, 0, {seed}
        while front and depth < limit:
            depth += 1
            front = {b for a in front if depth == 1 or a not in stop for b in to.get(a, ()) if b not in at}
            at |= dict.fromkeys(front, depth)
        return {(seed, n, d) for n, d in at.items() if d}

    up, down = {}, {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
        down.setdefault(b, set()).add(a)
    rows = lambda df: sorted((r.seed, r.node, r.depth) for r in df.collect())
    assert rows(g.closure(e, seeds)) == sorted(set().union(*(plain(s, up) for s in names)))
    assert rows(g.closure(e, seeds, "downstream", 3)) == sorted(set().union(*(plain(s, down, 3) for s in names)))
    stop = spark.createDataFrame([("P", "s", n) for n in ("n5", "n9")], "project_id string, snapshot_id string, node string")
    assert rows(g.closure(e, seeds, stop=stop)) == sorted(set().union(*(plain(s, up, stop=("n5", "n9")) for s in names)))
    found, chunks = g.masks(e, seeds)
    assert chunks.selectExpr("sum(size(seeds))", "max(size(seeds)) <= 64").first() == (200, True)
    assert found.count() * 3 < g.closure(e, seeds).count()
    # seeds that aren't all nodes: both ways are walked
    few = seeds.filter("seed in ('n7', 'n5', 'n20')")
    ways = {(r.seed, r.node): (r.depth, r.direction) for r in g.depth_map(e, few).collect()}
    want = {(s, s): (0, "self") for s in ("n7", "n5", "n20")}
    for s in ("n7", "n5", "n20"):
        want |= {(a, n): (d, "upstream") for a, n, d in plain(s, up)}
        want |= {(a, n): (d, "downstream") for a, n, d in plain(s, down)}
    assert ways == want


def test_nameof_targets_of_a_long_parameter(spark):
    """24,000 calls, each name twice: every call used to be set against all others."""
    text = ", ".join(f"NAMEOF('T'[M{i}]), nameof('t'[m{i}])" for i in range(12000)) + ", NAMEOF([M1]), NAMEOF([M1])"
    began = time.time()
    got = spark.createDataFrame([(text,)], "text string").select(F.explode(dax.nameof_targets(F.col("text"))).alias("t")).select("t.ref_table", "t.ref_name").collect()
    assert [tuple(r) for r in got] == [("T", f"M{i}") for i in range(12000)] + [(None, "M1")]
    assert time.time() - began < 60


def _over(df, name):
    """The operators of the plan that come after the first of a name, outermost first."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return lines[: next(i for i, x in enumerate(lines) if name in x)]


def test_offers_of_parameters_are_not_grouped_by_visual(spark):
    """300 visuals of two parameters that offer 1,500 measures, some shown already: pairs are written where they arise."""
    schema = "project_id string, snapshot_id string, page_id string, visual_id string, "
    offers = spark.createDataFrame([("p", "s", "AB"[i % 2], i, "measure", "T", f"M{i // 2 if i % 10 == 0 else i}") for i in range(1500)], "project_id string, snapshot_id string, parameter_table string, ordinal int, kind string, table_name string, name string")
    bound = spark.createDataFrame([("p", "s", "g", f"v{i}", x) for i in range(300) for x in ("AB" if i % 3 == 0 else "A" if i % 3 == 1 else "B")], schema + "parameter_table string")
    fields = spark.createDataFrame([("p", "s", "g", f"v{i}", "measure", "t", f"m{j}", via) for i in range(302) for j, via in ((2, "query"), (3, "filter"), (9999, "title"))], schema + "kind string, table_name string, name string, via string")
    df = report.expand_parameters(fields, bound, offers)
    want = set()
    by = {x: {r.name for r in offers.collect() if r.parameter_table == x} for x in "AB"}
    for i in range(302):
        sets = () if i >= 300 else "AB" if i % 3 == 0 else "A" if i % 3 == 1 else "B"
        names = {}
        for x in sets:
            for n in by[x]:
                names.setdefault(n, x)
        want |= {(f"v{i}", "T", n, "parameter", x) for n, x in names.items() if n != "M2"}
        want.add((f"v{i}", "t", "m2", "query", names.get("M2")))
        want.add((f"v{i}", "t", "m9999", "title", None))
        if "M3" not in names:
            want.add((f"v{i}", "t", "m3", "filter", None))
    got = [(r.visual_id, r.table_name, r.name, r.via, r.via_parameter) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert not any("Aggregate" in x or "Join" in x for x in _over(df, "Generate explode"))


def test_impact_is_counted_without_its_pairs(spark):
    """Counts, firsts and pairs against a plain walk; visuals bound alike are one row of a chunk."""
    from lineagrid.plans.graphs import impact, impact_counts, ways

    reads = [(f"m{i}", f"m{j}") for i in range(1, 90) for j in {i // 2, i // 3} if i != j] + [("m1", "m2")]
    shows = [(f"v{i}", f"m{i * 7 % 90}") for i in range(60)] + [(f"w{i}", f"m{i}") for i in range(8)]
    offers = [("ABC"[i % 3], f"m{i}") for i in range(0, 90, 2)] + [("B", "m0")]
    bound = [(f"w{i}", x) for i in range(120) for x in ("A", "B", "AC", "D")[i % 4]]
    kinds = {"measure_to_measure": reads, "visual_to_field": shows + bound, "field_param_to_field": offers}
    edges = spark.createDataFrame([("P", "s", a, b, k) for k, e in kinds.items() for a, b in e], "project_id string, snapshot_id string, source string, target string, type string")
    seeds = spark.createDataFrame([("P", "s", f"m{i}") for i in range(91)], "project_id string, snapshot_id string, seed string")
    applied = spark.createDataFrame([("P", "s", f"{x}{i}") for x in "vw" for i in range(0, 120, 5)], "project_id string, snapshot_id string, visual string")
    want, by = set(), {b: {a for a, c in reads if c == b} for _, b in reads}
    for seed in (f"m{i}" for i in range(91)):
        at, front = {seed}, {seed}
        while front:
            front = {a for b in front for a in by.get(b, ())} - at
            at |= front
        own = {v for v, x in bound if (x, seed) in offers}
        hit = {v for v, m in shows if m in at} | {v for v, x in bound if {m for y, m in offers if y == x} & at}
        want |= {(seed, "direct", v) for v in hit} | {(seed, "field_parameter", v) for v in own} | {(seed, "calculation_group", v) for v in hit if int(v[1:]) % 5 == 0}
    pairs = [(r.seed, r.kind, r.visual) for r in impact(edges, seeds, applied).collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    count = {}
    for seed, kind, v in want:
        n, first = count.get((seed, kind), (0, v))
        count[seed, kind] = n + 1, min(first, v)
    assert {(r.seed, r.kind): (r.n_visuals, r.first_visual) for r in impact_counts(edges, seeds, applied).collect()} == count
    chunks, _, shown, given = ways(edges, seeds)
    assert (shown.count() + given.count()) * 8 < len(pairs) and given.count() <= 3 * chunks.count()


def test_a_visual_is_answered_in_one_row(spark):
    """What comes to a visual is one row, whatever number of chunks its seeds lie in; it used to be a row for each chunk, grouped by visual and chunk."""
    from lineagrid.plans.graphs import ways

    reads = [(f"m{i}", f"m{j}") for i in range(1, 400) for j in {i // 2, i // 3} if i != j] + [("m1", "m2")]
    shows = [(f"v{i}", f"m{i * k % 400}") for i in range(300) for k in (7, 11, 13)]
    kinds = {"measure_to_measure": reads, "visual_to_field": shows + [("v1", "T")], "field_param_to_field": [("T", "m9")]}
    edges = spark.createDataFrame([("P", "s", a, b, k) for k, e in kinds.items() for a, b in e], "project_id string, snapshot_id string, source string, target string, type string")
    seeds = spark.createDataFrame([("P", "s", f"m{i}") for i in range(400)], "project_id string, snapshot_id string, seed string")
    names, visuals, shown, given = ways(edges, seeds)
    assert names.count() == 400 and shown.count() == visuals.count() == 300 and given.count() == 1
    assert shown.filter("size(seeds) <> size(own) or size(array_distinct(seeds)) < size(seeds)").isEmpty()
    assert shown.select(F.explode("seeds")).distinct().count() > 64


def test_ends_of_an_impact_are_found_without_depths(spark):
    """An end node that a chunk reaches in many depths is one row; it used to be one for each depth. Edges that come twice change nothing, and seeds that lead nowhere don't walk."""
    edges = [(f"n{i}", f"n{i + 1}") for i in range(3)] * 2 + [(f"n{i}", "end") for i in range(4)] + [("n2", "n0")]
    e = spark.createDataFrame([("P", "s", a, b) for a, b in edges], "project_id string, snapshot_id string, source string, target string")
    seeds = spark.createDataFrame([("P", "s", f"n{i}") for i in range(3)], "project_id string, snapshot_id string, seed string")
    found, chunks = g.masks(e, seeds, depths=False)
    assert found.filter("node = 'end'").count() == 1 and chunks.count() == 1
    own = g.closure(e, seeds).select("seed", "node").distinct()
    assert sorted(map(tuple, g.unfolded(found.filter("depth > 0"), chunks).select("seed", "node").collect())) == sorted(map(tuple, own.collect()))
    end = spark.createDataFrame([("P", "s", "end")], "project_id string, snapshot_id string, seed string")
    assert [(r.node, r.depth) for r in g.masks(e, end)[0].collect()] == [("end", 0)]


def test_edges_of_closures_are_counted_folded(spark):
    """No sort, join or grouping has a row for each seed and edge; the least target used to be found by sorting those."""
    edges = [(f"n{i:03}", f"n{j:03}") for i in range(1, 9) for j in {i // 2, i // 3} if i != j] + [("n001", "n002"), ("n007", "leaf"), ("n007", "leaf")]
    e = spark.createDataFrame([("P", "s", a, b) for a, b in edges], "project_id string, snapshot_id string, source string, target string")
    seeds = spark.createDataFrame([("P", "s", f"n{i:03}") for i in range(9)], "project_id string, snapshot_id string, seed string")
    df = g.subgraph_sizes(e, seeds)
    want = {}
    for r in g.subgraph(e, seeds, "upstream").collect():
        n, first = want.get(r.seed, (0, r.target))
        want[r.seed] = n + 1, min(first, r.target)
    assert {r.seed: (r.n_edges, r.first_target) for r in df.collect()} == want
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_what_visuals_show_is_made_distinct_by_numbers(spark):
    df = view(spark, SF, "b_shown")
    own = spark.sql(VIEWS["b_shown"], b_field=view(spark, SF, "b_field"), b_measure=view(spark, SF, "b_measure"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, own.collect()))
    assert not any("Aggregate" in x for x in _over(df, "Join"))


def test_unions_against_a_plain_walk(spark, monkeypatch):
    """Things in small parts and in many slices, members that no chunk holds, things without any, seeds left out, two projects of the same numbers."""
    from lineagrid.operators import unions as u

    for name, value in {"_SLICE": 5, "_AT_ONCE": 40}.items():
        monkeypatch.setattr(u, name, value)
    reach = {c * 64 + k: {(c * 7 + k * d) % 50 for d in (1, 3, 4)} | {k % 50} for c in range(3) for k in range(64)}
    bit = lambda k: (1 << k) - (1 << 64 if k == 63 else 0)
    rows = []
    for c in range(3):
        of = {}
        for k in range(64):
            for x in reach[c * 64 + k]:
                of[x] = of.get(x, 0) | bit(k)
        rows.append((c, list(of), list(of.values()), [k % 50 if k % 5 else None for k in range(64)]))
    closure = spark.createDataFrame([(p, "s", *r) for p in "PQ" for r in rows], "project_id string, snapshot_id string, chunk long, nodes array<long>, masks array<long>, selves array<long>")
    things = [(i, 1 if i % 3 == 0 else 2 if i % 3 == 1 else None, sorted({i * 5 % 192, i * 11 % 192, 9999})) for i in range(70)] + [(70, None, []), (71, None, [9999])]
    df = spark.createDataFrame([(p, "s", *t, f"n{t[0]}") for p in "PQ" for t in things], "project_id string, snapshot_id string, no long, given long, at array<long>, name string")
    had = spark.createDataFrame([(p, "s", 1, [3, 4, 20, 49]) for p in "PQ"], "project_id string, snapshot_id string, given long, seeds array<long>")
    want = {}
    for no, given, at in things:
        all_ = {x for a in at for x in reach.get(a, ())} - ({3, 4, 20, 49} if given == 1 else set())
        own = {a % 64 % 50 for a in at if a in reach and a % 64 % 5}
        if all_:
            want[no] = sorted((x, x in own) for x in all_)
    for p in "PQ":
        got = [r for r in u.unions(closure, df, had, ["name"]).collect() if r.project_id == p]
        assert len(got) == len(want) and all(r.name == f"n{r.no}" for r in got)
        assert {r.no: sorted(zip(r.seeds, r.own, strict=True)) for r in got} == want


def test_closures_unfold_after_they_are_counted(spark):
    """Seeds stay folded up to the last step: no join or grouping of the plan has a row for each pair of a seed and a node, and rows written in between are few."""
    from lineagrid.plans import graphs

    chunks, found = graphs._measure_columns(spark, SF)
    assert {"chunk", "mask", "parent", "column"} <= set(found.columns) and chunks.selectExpr("max(size(seeds)) <= 64").first()[0]
    assert not any("Aggregate" in x or "Join" in x for x in _over(graphs.g11_source_table(spark, SF), "Generate explode"))
    edges = spark.createDataFrame([("P", "s", f"n{i:03}", f"n{j:03}") for i in range(1, 200) for j in {i // 2, i // 3} if i != j], "project_id string, snapshot_id string, source string, target string")
    seeds = spark.createDataFrame([("P", "s", f"n{i:03}") for i in range(200)], "project_id string, snapshot_id string, seed string")
    chain = g.chain_edges(edges, seeds)
    member = g.closure(edges, seeds).select("seed", "node").union(seeds.selectExpr("seed", "seed")).toDF("seed", "source")
    assert sorted((r.seed, r.parent, r.node) for r in chain.collect()) == sorted((r.seed, r.source, r.target) for r in member.join(edges, "source").collect())
    assert not any("Aggregate" in x for x in _over(chain, "Generate explode"))
    n = {}
    for r in g.closure(edges, seeds).collect():
        n[r.seed] = min(n.get(r.seed, r.node), r.node)
    found, chunks = g.masks(edges, seeds)
    found = found.filter("depth > 0")
    names = g.numbered(found.select("project_id", "snapshot_id", "node").distinct(), "node")
    least = g.of_seeds(g.bits(found.join(names, ["project_id", "snapshot_id", "node"])).groupBy("project_id", "snapshot_id", "chunk", "k").agg(F.min("no").alias("no")), chunks)
    assert {r.seed: r.node for r in least.join(names.select("no", "node"), "no").collect()} == n


def test_objects_of_files_leave_in_small_batches():
    """A task's files used to be held parsed, all at once."""
    text = "table T\n" + "".join(f"\tmeasure m{i} = 1\n\t\tisHidden\n" for i in range(9))
    files = pa.record_batch({"project_id": ["p"] * 3, "snapshot_id": ["s"] * 3, "path": ["a", "b", "c"], "content": [text, None, text]})
    out = list(tmdl.batches(iter([files]), 4))
    assert [b.num_rows for b in out] == [4, 4, 4, 4, 4]
    got = [r for b in out for r in b.to_pylist()]
    assert [(r["path"], r["ordinal"]) for r in got] == [(f, i) for f in "ac" for i in range(10)]
    assert got[-1]["name"] == "m8" and got[-1]["table_name"] == got[-1]["parent"] == "T" and dict(got[-1]["props"]) == {"isHidden": "true"}


def test_calls_of_use_relationship_read_comments_once(spark):
    text = """USERELATIONSHIP('it]s T'[a'b], U_1[c d]) + userelationship(A[b], 'C, d'[e$1]) // USERELATIONSHIP(N[n], N[n])"""
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(dax.use_relationships(F.col("t")).alias("u"))
    assert [r.u and [tuple(x) for x in r.u] for r in df.collect()] == [[("it]s T", "a'b", "U_1", "c d"), ("A", "b", "C, d", "e$1")], [], None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("//") == 1


def test_lines_are_not_sorted_to_meet_visuals_and_measures(spark):
    """The sort of all of a task's lines was what held its memory."""
    from lineagrid.plans import models

    for df in (models._fields(spark, SF), view(spark, SF, "b_shown")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


def test_relationships_meet_the_names_of_their_model_once(spark):
    """One join for both ends, and none of the relationships moves after they were dealt by project; each end used to be joined with all tables."""
    from lineagrid.operators import shape

    rels = [("p", "s", "A", "B"), ("p", "s", "A", "X"), ("p", "s", "X", "B"), ("p", "s", None, "B"), ("q", "s", "A", "B"), ("p", "t", "A", "A"), ("p", "t", "A", "B")]
    tables = [("p", "s", "A"), ("p", "s", "B"), ("p", "s", "B"), ("p", "s", None), ("p", "t", "A")]
    k = shape.known_relationships(spark.createDataFrame(rels, "project_id string, snapshot_id string, from_table string, to_table string"), spark.createDataFrame(tables, "project_id string, snapshot_id string, name string"))
    assert k.columns == ["project_id", "snapshot_id", "from_table", "to_table", "dangling"]
    got = [tuple(r) for r in k.collect()]
    assert len(got) == len(rels) and {r[:4] for r in got if not r[4]} == {("p", "s", "A", "B"), ("p", "t", "A", "A")}
    df = shape.known_relationships(view(spark, SF, "b_rel"), view(spark, SF, "b_table"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan
    assert sum("(project_id" in x for x in moved) == 2 and not any("from_table" in x or "to_table" in x for x in moved)


def test_conditions_of_a_part_are_counted_together(spark):
    from lineagrid.operators import shape

    schema = "project_id string, snapshot_id string, a boolean, b int"
    rows = spark.createDataFrame([("p", "s", True, 1), ("p", "s", None, 2), ("p", "t", False, 2), ("q", "s", True, 2), ("x", "s", True, 2)], schema)
    more = spark.createDataFrame([("q", "s"), ("q", "s")], "project_id string, snapshot_id string")
    projects = spark.createDataFrame([("p", "s"), ("p", "t"), ("q", "s"), ("r", "s")], "project_id string, snapshot_id string")
    got = [tuple(r) for r in shape.observations(projects, [(rows, {"is a": F.col("a"), "two": F.col("b") == 2}), (more, {"more": F.lit(True)})]).collect()]
    assert sorted(got) == [("p", "s", "is a", 1), ("p", "s", "two", 1), ("p", "t", "two", 1), ("q", "s", "is a", 1), ("q", "s", "more", 2), ("q", "s", "two", 1)]


def test_files_are_read_once_for_graph_and_source_map(spark, monkeypatch):
    """The documents' job read and parsed all files twice, each time in as few tasks as their table of rows has."""
    from lineagrid.operators import estate
    from lineagrid.plans import jobs

    read, dealt = [], []
    own, own_bodies = tmdl.rows, estate.bodies

    def rows(files):
        read.append(files)
        return own(files)

    def bodies(g):
        dealt.append(g)
        return own_bodies(g)

    monkeypatch.setattr(estate.tmdl, "rows", rows)
    monkeypatch.setattr(estate, "bodies", bodies)
    assert jobs.s7_documents(spark, SF).columns == ["project_id", "line_no", "line"]
    assert len(read) == len(dealt) == 1
    paths = [r[0] for r in read[0].select("path").collect()]
    v = jobs.model_files(spark, SF).unionByName(jobs.report_files(spark, SF)).filter("path like '%.tmdl'")
    assert sorted(paths) == sorted(r[0] for r in v.select("path").collect())
    plan = read[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "replace(" not in plan
