import itertools
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import names as nm
from evenkeel.operators import matching as mt, nearest
from evenkeel.operators.windows import top_per_key
from evenkeel.plans import mapping as plan
from evenkeel.suite import fixtures as fx

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_is_lcs_ratio(spark):
    rnd = random.Random(7)
    words = ["", "a", "createdat", "createddt", "custid", "customerid"]
    words += ["".join(rnd.choice("abcd1") for _ in range(n)) for n in (5, 30, 61, 62, 90)]
    pairs = list(itertools.product(words, words))
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", nm.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = r["a"], r["b"]
        expected = 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0
        assert r["s"] == pytest.approx(expected), (a, b)


def test_one_deletion_forms_find_every_close_pair(spark):
    words = ["", "a", "ab", "ba", "abc", "abd", "bc", "xabc", "aabc"]
    frame = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    rows = frame.select(
        nm.within_one_edit(F.col("a"), F.col("b")).alias("close"),
        F.arrays_overlap(nm.one_deletion_forms(F.col("a")),
                         nm.one_deletion_forms(F.col("b"))).alias("meet"),
    ).collect()
    assert all(r["meet"] for r in rows if r["close"])


def test_fuzzy_candidates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mt, "CHUNK_NAMES", 7)  # several chunks per table
    source = fx.derive(spark, SF, fx.SOURCE_CATALOG)
    target = fx.derive(spark, SF, fx.TARGET_CATALOG)
    got = {}
    for r in mt.fuzzy_candidates(source, target).collect():
        got.setdefault((r["table"], r["source_column"]), []).append(
            (r["candidate_rank"], r["target_column"]))

    def key(n):
        return "".join(c for c in n.lower() if c.isalnum())

    targets = [(r["table"], r["ordinal"], r["name"]) for r in target.collect()]
    for r in source.collect():
        a = key(r["name"])
        scored = sorted(
            (-2 * lcs(a, key(n)) / (len(a) + len(key(n))), o, n)
            for t, o, n in targets if t == r["table"])
        expected = [(i, n) for i, (_, _, n) in enumerate(scored[:5], 1)]
        assert sorted(got[(r["table"], r["name"])]) == expected


def tables(spark):
    return (fx.derive(spark, SF, fx.SOURCE_TABLES), fx.derive(spark, SF, fx.TARGET_TABLES))


def _ratio(a, b):
    a, b = ("".join(c for c in x.lower() if c.isascii() and c.isalnum()) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[j - 1]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0


def test_match_tables_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mt, "CHUNK_NAMES", 3)
    source, target = tables(spark)
    # the same name three times, once in another case, is one target
    target = target.unionByName(target.limit(20)).unionByName(
        target.limit(20).withColumn("table", F.lower("table")))
    got = {}
    for r in mt.match_tables(source, target).collect():
        got.setdefault((r["schema"], r["source_table"]), []).append(
            (r["candidate_rank"], r["target_table"], r["percent"]))
    by_schema = {}
    for r in target.collect():
        stored = by_schema.setdefault(r["schema"], {})
        up = r["table"].upper()
        stored[up] = min(stored.get(up, r["table"]), r["table"])
    for r in source.collect():
        names, up = by_schema.get(r["schema"], {}), r["table"].upper()
        if up in names:
            expected = [(1, names[up], 100)]
        else:
            scored = sorted((-_ratio(up, n), n) for n in names.values())
            expected = [(i, n, int(-s * 100)) for i, (s, n) in enumerate(
                [x for x in scored if -x[0] >= 0.30][:5], 1)]
        assert sorted(got.get((r["schema"], r["table"]), [])) == expected


@pytest.mark.parametrize("seed", range(6))
def test_nearest_names_equal_brute_force(seed, monkeypatch):
    """Short and long keys, equal keys under several names, and cuts while hits come in."""
    if seed % 2:
        monkeypatch.setattr(nearest, "STATES", 7)
        monkeypatch.setattr(nearest, "HITS", 11)
    rnd = random.Random(seed)
    letters, most = rnd.choice(["ab1", "abcdefghij0123456789"]), [5, 14, 140][seed % 3]

    def word():
        return "".join(rnd.choice(letters) for _ in range(rnd.choice([rnd.randint(0, most), most // 2])))

    base = word()
    keys = [rnd.choice([word(), base[: rnd.randint(0, len(base))] + word()[:3]]) for _ in range(50)]
    names = [f"{k.upper()}_{i}" for i, k in enumerate(keys)]
    asked = [word() for _ in range(12)] + [base, base + "a", ""]
    for low, n in ((0, 2), (0.3, 5), (0.4, 3), (1.0, 1)):
        expected = []
        for i, a in enumerate(asked):
            scored = [(-(2.0 * lcs(a, k) / (len(a) + len(k)) if a and k else 0.0), name)
                      for k, name in zip(keys, names)]
            expected += [(i, name, -s) for s, name in sorted(x for x in scored if -x[0] >= low)[:n]]
        asker, found, score = nearest.nearest(asked, names, keys, low, n)
        assert sorted(zip(asker, (names[i] for i in found), score)) == sorted(expected)


def test_table_cells_find_what_one_scan_finds(spark, monkeypatch):
    """Several chunks and slices per schema; empty and NULL names match nothing."""
    source, target = tables(spark)
    odd = spark.createDataFrame(
        [("schema_1", None), ("schema_1", "__"), (None, "x")], "schema string, table string")
    source, target = source.unionByName(odd), target.unionByName(odd)
    whole = mt.similar_tables(source, target).collect()
    monkeypatch.setattr(mt, "CHUNK_TABLES", 3)
    monkeypatch.setattr(mt, "SLICE_TABLES", 2)
    assert sorted(whole) == sorted(mt.similar_tables(source, target).collect())
    assert whole and {r["source_table"] for r in whole}.isdisjoint({None, "__", "x"})


@pytest.mark.parametrize("find", ["match_tables", "suggest_targets"])
def test_tables_do_not_meet_every_chunk_of_their_schema(spark, find):
    source = spark.range(400).select(
        F.lit("s").alias("schema"), F.format_string("customer_%09d", "id").alias("table"))
    target = spark.range(2000).select(
        F.lit("s").alias("schema"), F.format_string("CUSTOMER%09d", "id").alias("table"))
    confirmed = spark.createDataFrame([], "source_table string, target_table string")
    more = [confirmed] if find == "suggest_targets" else []
    assert _join_rows(getattr(mt, find)(source, target, *more)) <= 2400


def test_suggest_targets_uses_stored_names(spark):
    source = spark.createDataFrame(
        [("s", "orders"), ("s", "ordres"), ("s", "zzz"), ("s", "seen"), ("none", "t")],
        "schema string, table string")
    target = spark.createDataFrame(
        [("s", "Orders"), ("s", "ORDERS"), ("s", "orders")], "schema string, table string")
    confirmed = spark.createDataFrame([("seen", "Kept")], "source_table string, target_table string")
    got = {r["source_table"]: (r["target_table"], r["status"])
           for r in mt.suggest_targets(source, target, confirmed).collect()}
    assert got == {"orders": ("ORDERS", "exact"), "ordres": ("ORDERS", "fuzzy"),
                   "zzz": ("", "not_found"), "seen": ("Kept", "confirmed"), "t": ("T", "no_data")}


def test_exact_match_precedence(spark):
    cols = "table string, ordinal int, name string, type string"
    source = spark.createDataFrame(
        [("t", 1, "User_Id", "int"), ("t", 2, "sName", "text"), ("t", 3, "wish", "text"),
         ("t", 4, "lost", "text")], cols)
    target = spark.createDataFrame(
        [("t", 1, "USERID", "NUMBER"), ("t", 2, "USER_ID", "NUMBER"), ("t", 3, "SNAME", "TEXT"),
         ("t", 4, "S_NAME", "TEXT"), ("t", 5, "GRANTED", "TEXT")], cols)
    wish = spark.createDataFrame([("t", "WISH", "granted"), ("t", "lost", "nowhere")],
                                 "table string, source_column string, target_column string")
    got = {r["source_column"]: (r["target_column"], r["match_method"])
           for r in mt.exact_match(source, target, wish).collect()}
    assert got == {"User_Id": ("USER_ID", "exact"), "sName": ("SNAME", "exact"),
                   "wish": ("GRANTED", "configured"), "lost": (None, None)}


def test_learned_pair_reaches_auto_accept(spark):
    cols = "table string, ordinal int, name string, type string"
    source = spark.createDataFrame([("t", 1, "created_at", "timestamp")], cols)
    target = spark.createDataFrame([("t", 1, "CREATED_DT", "TIMESTAMP_NTZ")], cols)
    plain = mt.match_columns(source, target).collect()[0]
    assert (plain["decision"], plain["needs_review"]) == ("resolved", True)
    assert plain["confidence"] == pytest.approx(0.4 * 16 / 18 + 0.35 + 0.1)
    learned = spark.createDataFrame([("CREATED_AT", "created_dt")],
                                    "source_column string, target_column string")
    sure = mt.match_columns(source, target, learned=learned).collect()[0]
    assert (sure["decision"], sure["needs_review"]) == ("resolved", False)


def test_lonely_columns_are_unmatched(spark):
    cols = "table string, ordinal int, name string, type string"
    source = spark.createDataFrame(
        [("t", 1, "a", "int"), ("u", 1, "b", "int"), ("t", 2, "_fivetran_id", "text")], cols)
    target = spark.createDataFrame([("t", 1, "A", "NUMBER")], cols)
    got = {r["source_column"]: (r["decision"], r["skip"]) for r in
           mt.match_columns(source, target).collect()}
    assert got == {"a": ("resolved", False), "b": ("unmatched", True),
                   "_fivetran_id": ("resolved", True)}


def test_top_per_key_limits_before_the_shuffle(spark):
    frame = spark.range(100).withColumn("k", F.col("id") % 3)
    text = top_per_key(frame, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan()
    assert "WindowGroupLimit" in text.toString()


def test_learned_examples_ignore_repeats(spark):
    """Thousands of examples of one name and type do not change the five best."""
    learned = spark.range(5000).select(
        F.col("id").alias("seq"), F.lit("id").alias("source_column"),
        F.concat(F.lit("T"), "id").alias("target_column"), F.lit("int").alias("source_type"),
        F.lit("NUMBER").alias("target_type"))
    asked = spark.createDataFrame(
        [("r", "ID", "int", ["t4999"], ["NUMBER"]), ("q", "other", "int", [], [])],
        "request_id string, name string, type string, target_names array<string>, "
        "target_types array<string>")
    rows = mt.relevant_examples(asked, learned).collect()
    best = [(r["seq"], r["score"]) for r in sorted(rows, key=lambda r: r["example_rank"])
            if r["request_id"] == "r"]
    assert best == [(4999, 18), (0, 14), (1, 14), (2, 14), (3, 14)]
    other = [r["seq"] for r in rows if r["request_id"] == "q"]
    assert sorted(other) == [0, 1, 2, 3, 4]


def _join_rows(frame):
    """The most rows that a join of the executed plan put out."""
    frame.collect()
    most, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in name:
            most = max(most, node.metrics().get("numOutputRows").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_learned_examples_by_types_do_not_multiply(spark):
    """Sixty types that share a target type put a handful of examples before each request."""
    learned = spark.range(600).select(
        F.col("id").alias("seq"), F.concat(F.lit("learned"), "id").alias("source_column"),
        F.concat(F.lit("T"), "id").alias("target_column"),
        F.concat(F.lit("type"), F.col("id") % 60).alias("source_type"),
        F.lit("VARCHAR").alias("target_type"))
    asked = spark.range(500).select(
        F.concat(F.lit("r"), "id").alias("request_id"),
        F.concat(F.lit("asked"), F.col("id") * 1000).alias("name"),
        F.concat(F.lit("type"), F.col("id") % 60).alias("type"),
        F.array(F.lit("NONE")).alias("target_names"), F.array(F.lit("VARCHAR")).alias("target_types"))
    best = mt.relevant_examples(asked, learned)
    assert {r["seq"] % 60 for r in best.filter("request_id = 'r7'").collect()} == {7}
    assert _join_rows(best) <= 500 * 10


def test_learned_examples_against_brute_force(spark):
    """Repeated and empty requests and examples count as often as they occur."""
    rnd = random.Random(5)
    names = ["Id", "id", "ids", "i_d", "code", "cod", "node", "", None, "a1", "a2", "b_1"]
    pick = lambda *x: rnd.choice([*x, None])
    learned = [(i, rnd.choice(names), pick("ID", "CODE", "X"), pick("int", "INT", "text", "uuid"),
                pick("NUMBER", "TEXT")) for i in range(60)]
    learned += [learned[3], learned[3], learned[40], (None, "id", "ID", "int", "NUMBER")]
    asked = [(f"r{i}", rnd.choice(names), pick("int", "TEXT", "uuid"),
              rnd.choice([None, [], ["id"], ["Id", "code", None], ["x", "X"]]),
              rnd.choice([None, [], ["number"], ["TEXT", None, "number"]])) for i in range(40)]
    asked += [asked[0], asked[1], asked[1], ("r2", "code", "int", ["x"], ["TEXT"]),
              (None, "id", "int", ["id"], ["NUMBER"])]
    key = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    up = lambda x: None if x is None else x.upper()

    def close(a, b):
        cut = lambda x: {x[:i] + x[i + 1:] for i in range(len(x))}
        return (a in cut(b) or b in cut(a) or len(a) == len(b)
                and sum(x != y for x, y in zip(a, b)) <= 1)

    expected = {}
    for rid, name, kind, targets, kinds in asked:
        for seq, source, target, source_type, target_type in learned:
            if rid is None or seq is None:
                continue
            score = (10 if name is not None and up(name) == up(source) else
                     6 if key(name) == key(source) else 3 if close(key(name), key(source)) else 0)
            score += 2 if kind is not None and up(kind) == up(source_type) else 0
            score += 4 if target is not None and up(target) in map(up, targets or []) else 0
            score += 2 if target_type is not None and up(target_type) in map(up, kinds or []) else 0
            if score:
                expected.setdefault(rid, []).append((-score, seq, source, target))
    columns = "seq long, source_column string, target_column string, source_type string, target_type string"
    requests = ("request_id string, name string, type string, target_names array<string>, "
                "target_types array<string>")
    got = {}
    for r in mt.relevant_examples(spark.createDataFrame(asked, requests),
                                  spark.createDataFrame(learned, columns)).collect():
        got.setdefault(r["request_id"], []).append(
            (r["example_rank"], -r["score"], r["seq"], r["source_column"], r["target_column"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        k: [(i, *x) for i, x in enumerate(sorted(v, key=lambda x: x[:2])[:5], 1)]
        for k, v in expected.items()}


def test_plan_round_trip(spark, tmp_path):
    from evenkeel.sources import sinks

    source = fx.derive(spark, SF, fx.SOURCE_CATALOG)
    target = fx.derive(spark, SF, fx.TARGET_CATALOG)
    built = plan.build_mapping(mt.match_columns(source, target))
    path = str(tmp_path / "plans")
    sinks.write_plan(built, path)
    back = sinks.read_plan(spark, path, plan.MAPPING_SCHEMA)
    names = plan.MAPPING_SCHEMA.names
    assert back.select(*names).exceptAll(built.select(*names)).count() == 0
    one = sinks.read_plan(spark, path, plan.MAPPING_SCHEMA, "table_1")
    assert one.select("table").distinct().collect()[0][0] == "table_1"
