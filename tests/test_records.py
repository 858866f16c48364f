"""Golden rows of the other operators."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from concord.functions import geometry as g
from concord.functions.globs import glob_regex, is_concrete
from concord.functions.json import pointer_pattern
from concord.functions.versions import level_of, normalize_version, version_key
from concord.operators import fleet, ledger, normalise, reserved, rings, rules, scan, sweep, validate
from concord.operators.nodes import json_nodes
from concord.sources.corpus import decode_audit, scan_corpus, with_contents
from concord.sources.hourly import read_hourly
from concord.sources.report import write_findings, write_report
from concord.sources.rings import parse_rings, read_provenance, read_rings, report_rows, ring_rejects
from concord.sources.statements import statements


def column(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.x for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_pointer_and_error_patterns(spark):
    got = column(spark, ["/List/x/equipment/3/f", "", "/T/12"], "string", pointer_pattern)
    assert got == ["/List/*/equipment/#/f", "/", "/T/*"]
    got = column(spark, ["\n at /a/b c 12\nnext", "  ", None], "string", sweep.error_pattern)
    assert got == ["at <path> c #", "<no message>", "<no message>"]


def test_statements(spark):
    text = "Version,\n  26.1;\n\n/* a block */\n\nZone,\n  My\n  Zone, ! comment; here\n  0.0, ;\nTail,\n  cut"
    rows = statements(spark.createDataFrame([("m", text)], "m string, content string"), ["m"]).collect()
    got = [(r.line, r.obj_type, r.pos, r.raw, r.terminated) for r in sorted(rows, key=lambda r: (r.seq, r.pos or 0))]
    assert got == [
        (1, "Version", 0, "26.1", True),
        (4, "/* a block */ Zone", 0, "My Zone", True),
        (4, "/* a block */ Zone", 1, "0.0", True),
        (4, "/* a block */ Zone", 2, "", True),
        (10, "Tail", 0, "cut", False),
    ]


def test_partial_group_and_synthetic_names(spark):
    df = spark.createDataFrame([("o", i, v) for i, v in enumerate(["n", "a", "b", "c", "", "d"])] + [("p", 0, "n")], "k string, pos int, raw string")
    got = sorted(map(tuple, normalise.fold_groups(df, ["k"], "pos", "raw", 1, ["x", "y"]).collect()))
    assert got == [("o", 0, "a", "b"), ("o", 1, "c", None), ("o", 2, "d", None)]
    objects = spark.createDataFrame([(1, "T", False, None), (2, "N", True, ""), (3, "T", False, "T 1"), (4, "N", True, None)], "seq int, t string, named boolean, name string")
    got = {r.seq: r.key for r in normalise.object_key(objects, [], "t", "seq", "named", "name").collect()}
    assert got == {1: "T 1", 2: "", 3: "T 2", 4: ""}


def test_sentinels_follow_the_dictionary(spark):
    known = spark.createDataFrame([("f", "Autosize"), ("h", "Autosize"), ("h", "Autocalculate")], "field string, spelling string")
    df = spark.createDataFrame([("f", "AUTOCALCULATE"), ("f", "autosize"), ("h", "autosize"), ("h", "AutoCalculate"), ("z", "Autosize"), ("f", "3")], "field string, v string")
    got = [(r.field, r.out) for r in normalise.canon_sentinel(df, known, ["field"], "v", "out").collect()]
    assert sorted(got) == sorted([("f", "Autosize"), ("f", "Autosize"), ("h", "Autosize"), ("h", "Autocalculate"), ("z", "Autosize"), ("f", "3")])


def test_version_dictionary_is_never_the_closest_earlier(spark):
    dims = spark.createDataFrame([("8.9.0",), ("9.0.1",)], "version string")
    df = spark.createDataFrame([("9.0",), ("9.1",), ("8.9.0",)], "v string")
    assert {r.v: r.dictionary for r in normalise.resolve_version(df, "v", dims).collect()} == {"9.0": "9.0.1", "9.1": None, "8.9.0": "8.9.0"}


def test_lookup_in_any_casing(spark):
    zones = spark.createDataFrame([("Zone", 1, "One"), ("Zone", 2, "Two")], "t string, seq int, n string")
    asked = spark.createDataFrame([("zone",), ("ZONE",), ("Zoen",)], "query string")
    got = sorted((r.query, r.present, r.n) for r in normalise.lookup(zones, "t", "n", "seq", asked).collect())
    assert got == sorted([("zone", True, "One"), ("zone", True, "Two"), ("ZONE", True, "One"), ("ZONE", True, "Two"), ("Zoen", False, None)])


def test_any_of_codes(spark):
    branches = json.dumps([{"type": "number", "min": 0, "max": 1}, {"type": "string", "enum": ["", "Autocalculate"]}])
    numbers = json.dumps([{"type": "number", "enum": ["0", "1"]}])
    rows = [(branches, "number", -1.0, None), (branches, "string", None, "AUTOCALCULATE"), (branches, "string", None, "Bogus"),
            (branches, "number", 5.0, None), (numbers, "number", 3.0, None), (branches, "array", None, None), (numbers, "string", None, "0")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, jtype string, num double, str string")
    code = validate.value_code(F.from_json("b", validate.BRANCHES), F.col("jtype"), F.col("num"), F.col("str"))
    assert [r.c for r in df.orderBy("i").select(code.alias("c")).collect()] == ["E005", None, "E004", "E007", "E004", "E002", "E003"]


def test_dangling_reference_in_a_group(spark):
    known = spark.sql(
        f"""SELECT obj_type, field, CAST(array() AS ARRAY<INT>) AS branches, object_list, reference FROM VALUES
        ('Zone', 'name', CAST(array() AS ARRAY<STRING>), array('Zones')), ('ZoneList', 'zone_name', array('Zones', 'Spaces'), array()),
        ('Fluid', 'fluid_name', array(), array('Spaces')), ('ZoneList', 'kind', array('Types'), array()) AS t(obj_type, field, object_list, reference)"""
    )
    rows = [("Zone", "1", "name", "Zone One"), ("Zone", "2", "name", "Zone Two"), ("Fluid", "f", "fluid_name", "Water"), ("ZoneList", "l", "zone_name", "zone one"),
            ("ZoneList", "l", "zone_name", "Zone Three"), ("ZoneList", "l", "zone_name", "WATER"), ("ZoneList", "l", "zone_name", " "), ("ZoneList", "l", "kind", "Zone")]
    values = spark.createDataFrame([(t, o, f, "string", None, s) for t, o, f, s in rows], "object_type string, object_name string, field string, jtype string, num double, str string")
    assert [(r.object_name, r.field, r.code) for r in validate.check_references(values, known).collect()] == [("l", "zone_name", "E009")]


def test_mean_divides_by_what_is_present(spark):
    df = spark.createDataFrame([("s", 1, 10.0), ("s", 1, 20.0), ("s", 1, 9999.0), ("s", 2, 9999.0), ("s", 3, 77777.0)], "st string, m int, v double")
    masked = df.withColumn("v", reserved.mask_reserved(F.col("v"), [9999.0]))
    got = {r.month: (r.mean, r.present) for r in reserved.monthly_means(masked, ["st"], F.col("m"), F.col("v")).collect()}
    assert len(got) == 12 and got[1] == (15.0, 2) and got[2] == (None, 0) and got[3] == (77777.0, 1)


def test_malformed_expectation_stops_the_run(spark):
    df = spark.createDataFrame([("s", [1.0] * 11, True, None, 0.05)], "st string, monthly array<double>, covered boolean, reason string, tolerance double")
    with pytest.raises(Exception, match="not twelve numbers"):
        reserved.coverage(df, ["st"]).collect()


SQUARE = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (4.0, 4.0, 0.0), (0.0, 3.0, 0.0)]


def test_ring_errors(spark):
    pairs = [
        (SQUARE, SQUARE[1:] + SQUARE[:1]),
        (SQUARE, SQUARE[::-1]),
        (SQUARE, SQUARE[:3] + [(0.0, 3.0, 2.0)]),
        (SQUARE, [(x + 0.003, y - 0.003, z + 0.003) for x, y, z in SQUARE]),
        (SQUARE, SQUARE[:3]),
        ([], []),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a array<{g.VERTEX}>, b array<{g.VERTEX}>")

    def brute(a, b):
        if len(a) != len(b) or not a:
            return None
        return min(max(max(abs(p - q) for p, q in zip(a[(i + s) % len(a)], b[i])) for i in range(len(a))) for s in range(len(a)))

    got = [r.e for r in df.orderBy("i").select(g.ring_error(F.col("a"), F.col("b")).alias("e")).collect()]
    assert got == [brute(a, b) for a, b in pairs] and got[0] == 0.0 and got[1] > 0


def test_building_turns_by_minus_the_axis(spark):
    ring = spark.createDataFrame([("m", "a", "Wall", None, [(50.0, 0.0, 0.0)]), ("m", "b", "Shading:Site:Detailed", None, [(50.0, 0.0, 0.0)])], f"model string, name string, kind string, zone string, vertices array<{g.VERTEX}>")
    rule = spark.createDataFrame([("m", "World", 158.434, "CounterClockWise", "UpperLeftCorner")], "model string, coordinate_system string, north_axis double, entry_direction string, starting_vertex string")
    zone = spark.createDataFrame([], "model string, zone string, x double, y double, z double, rel_north double")
    got = {r.name: (round(r.vertices[0].x, 2), round(r.vertices[0].y, 2)) for r in rings.to_world(ring, rule, zone).collect()}
    assert got == {"a": (-46.5, -18.38), "b": (50.0, 0.0)}


def test_ring_files_and_reports(spark, tmp_path):
    (tmp_path / "r.csv").write_text('# engine: v1\n# frame: a => b\nkind,name,surface_class,base_surface,vertex_count,vertices\nWall,"A, b",Wall,,2,0.00,1.00,2.00,3.50,-4.00,5.00\n')
    [ring] = read_rings(spark, str(tmp_path / "r.csv")).collect()
    assert ring.name == "A, b" and [tuple(v) for v in ring.vertices] == [(0.0, 1.0, 2.0), (3.5, -4.0, 5.0)]
    assert {r.key: r.value for r in read_provenance(spark, str(tmp_path / "r.csv")).collect()} == {"engine": "v1", "frame": "a => b"}
    row = lambda kind, sides, cells: ",".join([kind, "n", "c", "b", *["0"] * 22, str(sides), *cells])
    lines = [row("HeatTransfer Surface", 1, "123"), row("Shading Surface", 2, "123"), row("Zone", 1, "123"), row("Shading Surface", 0, "")]
    kept, rejects = report_rows(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string"), ["i"])
    assert {r.i: len(r.vertices) for r in kept.collect()} == {0: 1, 3: 0} and [(r.i, r.sides, r.carried) for r in rejects.collect()] == [(1, 2, 1)]


def test_hourly_file_and_corpus(spark, tmp_path):
    data = ",".join(["2001", "2", "3", "4", "60", "flags", *[str(i) for i in range(6, 35)]])
    (tmp_path / "s.epw").write_bytes("\r\n".join(["h"] * 8 + [data, "", data]).encode())
    rows = read_hourly(spark, str(tmp_path / "*.epw")).orderBy("row").collect()
    assert [(r.row, r.month, r.dry_bulb_temperature, r.liquid_precipitation_quantity) for r in rows] == [(0, 2, 6.0, 34.0), (1, 2, 6.0, 34.0)]
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    files = with_contents(spark, scan_corpus(spark, str(tmp_path), "*.txt"), str(tmp_path))
    assert [tuple(r)[1:] for r in decode_audit(files, ["path"]).collect()] == [(False, 4, 4, True)]


def test_report_sink(spark, tmp_path):
    found = spark.createDataFrame([("value", 1), ("type", 2), ("value", 3)], "kind string, x int")
    write_findings(found, str(tmp_path / "f"))
    write_report({"totals": found.groupBy("kind").count()}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 3 and spark.read.json(str(tmp_path / "r/totals")).count() == 2


def test_sweep_of_nested_documents(spark):
    docs = {
        1: ({"a": {"0": {"x": 1}}}, {"a": [{"y": 2}]}, {"a": {"0": {"x": 1}}}),
        2: ({"a": [1, 2]}, {"a": [1]}, {"a": [1, 3]}),
        3: ({"k": float(1)}, {}, {"k": "1"}),
        4: ({"k": 1}, {"k": 1}, None),
    }
    rows = [(i, s, json.dumps(v)) for i, vs in docs.items() for s, v in zip("pqr", vs) if v is not None]
    df = spark.createDataFrame(rows, "id int, side string, j string")
    aligned = sweep.align_sides(json_nodes(df, ["id", "side"], "j"), ["id"], list("pqr"), df.select("id", "side"))
    got = sorted((r.id, r.ptr, r.kind, r.partition, r.differing_sides) for r in sweep.sweep_diff(aligned, ["id"], list("pqr")).collect())
    assert got == [(1, "/a", "type", "p=r | q", "q"), (2, "/a", "length", "p=r | q", "q"), (3, "/k", "absent", "p | q | r", "p,q,r")]


def test_reconcile_buckets(spark):
    out = spark.createDataFrame([(1, "fail"), (2, "pass"), (3, "skip"), (4, "error"), (5, "fail")], "case_id int, status string").withColumns({"library": F.lit("l"), "assertion": F.lit("a")})
    exc = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6, 9)], "case_id int").withColumns({"library": F.lit("l"), "assertion": F.lit("a")})
    selected = spark.createDataFrame([(i,) for i in range(1, 7)], "case_id int")
    buckets = ledger.reconcile(out, exc, selected)
    assert {r.case_id: r.bucket for r in buckets.collect()} == {1: "outstanding", 2: "stale", 3: "deferred", 4: "none", 6: "unexercisable", 9: "unselected"}
    assert sorted(r.case_id for r in ledger.blocking(out, buckets).collect()) == [4, 5]
    assert ledger.run_totals(out, exc, selected).first() == ledger.run_summary(out, buckets).first()
    assert ledger.run_summary(out, buckets).first().asDict() == {"pass": 1, "fail": 2, "skip": 1, "error": 1, "stale": 1, "unexercisable": 1, "blocking": 2, "green": False}


def test_selection_errors(spark):
    cases = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "id string, tags array<string>")
    with pytest.raises(Exception, match="name no case"):
        ledger.select_cases(cases, "id", "tags", ids=["a", "zz"]).collect()
    with pytest.raises(Exception, match="meets no case"):
        ledger.select_cases(cases, "id", "tags", any_of=["q"]).collect()
    assert ledger.select_cases(cases.limit(0), "id", "tags", any_of=["q"]).count() == 0


def test_cycles_against_brute_force(spark):
    rng = random.Random(11)
    edges = {(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(34)} | {(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 103), (7, 7)}
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    got = {r.node for r in rules.cycles(spark.createDataFrame(list(edges), "src int, dst int")).collect()}
    assert got == {a for a, b in reach if a == b}


def test_waves(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "zz")], "src string, dst string")
    assert {r.node: r.wave for r in fleet.waves(nodes, edges).collect()} == {"a": 1, "d": 1, "b": 2, "c": 3}
    with pytest.raises(Exception, match="cycle"):
        fleet.waves(nodes, edges.unionByName(spark.createDataFrame([("a", "c")], "src string, dst string")))


def test_versions(spark):
    assert column(spark, ["1.0.0-rc.4", " V1.0.0rc4 ", "2.0.0-alpha.1", "1.2"], "string", normalize_version) == ["1.0.0rc4", "1.0.0rc4", "2.0.0a1", "1.2"]
    got = fleet.newest(spark.createDataFrame([("1.0.0rc4",), ("1.0.0",), ("0.10.0",), ("0.9.3",)], "v string").withColumn("g", F.lit(1)), ["g"], "v").first()
    assert got.newest == "1.0.0"
    order = [r.v for r in spark.createDataFrame([(v,) for v in ("0.10.0", "1.0.0", "0.9.3", "1.0.0-rc.10", "1.0.0rc9")], "v string").orderBy(version_key(F.col("v"))).collect()]
    assert order == ["0.9.3", "0.10.0", "1.0.0rc9", "1.0.0-rc.10", "1.0.0"]
    raws = ["0.3.0-rc.2", "tool==0.15.0", "tool[x]@0.9.3", "tool", "tool>=1", "tool-lsp==1.0", "1.x"]
    assert column(spark, raws, "string", lambda v: level_of(v, F.lit("tool"))) == ["0.3.0-rc.2", "0.15.0", "0.9.3", None, None, None, None]


def test_release_spellings(spark):
    texts = {"26.1": 1, "v26.1.0": 1, "26-1": 1, "26_1": 1, "26, 1, 0": 1, "0.26.1": 0, "26.10": 0, "2026-10-13": 0, "126.1": 0, "26.1.07": 0, "a 26.1\nb 26-1-0": 2}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = scan.occurrences(df.withColumn("k", F.col("t")), ["k"], "t", scan.spellings(26, 1, 0))
    counts = {r.k: r.n for r in found.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert {t: counts.get(t, 0) for t in texts} == texts


def test_occurrences_against_python(spark):
    import re

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab\n ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["aa", "", "baab\n\naa"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = sorted((r.k, r.begin, r.stop, r.line, r.found) for r in scan.occurrences(df, ["k"], "t", "a+b?\\s").collect())
    want = sorted((i, m.start(), m.end(), t.count("\n", 0, m.start()) + 1, m.group()) for i, t in enumerate(texts) for m in re.finditer(r"a+b?\s", t))
    assert got == want


def test_globs():
    import re

    assert re.match(glob_regex("**/a?.txt").replace(r"\z", r"\Z"), "x/y/ab.txt") and re.match(glob_regex("**/a?.txt").replace(r"\z", r"\Z"), "ab.txt")
    assert not re.match(glob_regex("*/a.txt").replace(r"\z", r"\Z"), "x/y/a.txt") and is_concrete("a/b.txt") and not is_concrete("a/*.txt")


def test_every_query_has_sql_and_agrees_on_names():
    from __spark_entry__ import oracle_sql, queries
    from concord.queries import ORACLES, QUERIES

    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())
    assert set(QUERIES) == set(ORACLES)


def plain_statements(text):
    """(seq, line, terminated, type, fields) by one walk over the text."""
    out, part, begin, line, seq, noted = [], "", None, 1, 1, False

    def end(terminated):
        if part.strip():
            tidy = lambda c: re.sub(r"\s*[\r\n]+\s*", " ", c).strip(" ")
            cells = [tidy(c) for c in part.split(",")]
            out.append((seq, begin, terminated, cells[0], tuple(cells[1:])))

    for c in text:
        noted = c == "!" or noted and c not in "\r\n"
        if c == ";" and not noted:
            end(True)
            part, begin, seq = "", None, seq + 1
        elif not noted:
            if begin is None and not c.isspace():
                begin = line
            part += c
        line += c == "\n"
    end(False)
    return out


def test_statements_of_cut_files(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "B c", ",", ", ", ";", "; ", "! note; x", "!", "\n", "\r\n", " "]) for _ in range(rng.randrange(80))) for _ in range(120)]
    cuts = [sorted(rng.randrange(len(t) + 1) for _ in range(rng.randrange(8))) for t in texts]
    pieces = [(i, n, t[a:b]) for i, (t, c) in enumerate(zip(texts, cuts)) for n, (a, b) in enumerate(zip([0, *c], [*c, len(t)]))]
    cut = statements(spark.createDataFrame(pieces, "f int, place int, content string"), ["f"], at="place")
    whole = statements(spark.createDataFrame(list(enumerate(texts)), "f int, content string"), ["f"])
    want = sorted((i, *s[:4], n, v) for i, t in enumerate(texts) for s in plain_statements(t) for n, v in (enumerate(s[4]) if s[4] else [(None, None)]))
    key = lambda r: tuple((x is None, x) for x in r)
    for found in (whole, cut):
        got = [(r.f, r.seq, r.line, r.terminated, r.obj_type, r.pos, r.raw) for r in found.collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_ring_lines_that_disagree_are_rejected(spark):
    wide = "k,n,c,b,16000," + ",".join(["1.5"] * 48_000)
    lines = ['k,"a, ""b""",c,"",1,1,2,3', "k,short,c,b,2,1,2,3", "k,long,c,b,1,1,2,3,4", "k,word,c,b,1,1,x,3", 'k,"open,c,b,1,1,2,3', "k,none,c,b,x", "k,zero,c,b,0", wide, wide.replace("k,n,", 'k,"n,m",')]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    assert {(r.i, r.name, len(r.vertices)) for r in parse_rings(df, ["i"]).collect()} == {(0, 'a, "b"', 1), (6, "zero", 0), (7, "n", 16_000), (8, "n,m", 16_000)}
    assert {r.i: r.reject for r in ring_rejects(df, ["i"]).collect()} == {1: "2 vertices stated, 3 numbers", 2: "1 vertices stated, 4 numbers", 3: "no number", 4: "quote not closed", 5: "no count"}


def test_a_listing_reads_no_content(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.bin"):
        (tmp_path / name).write_text(name * 3)
    listing = scan_corpus(spark, str(tmp_path), "*.txt", 1)
    assert [(r.path[-5:], r.size) for r in listing.collect()] == [("a.txt", 15)] and "content" not in listing.columns
    assert [bytes(r.content) for r in with_contents(spark, listing, str(tmp_path)).collect()] == [b"a.txt" * 3]
