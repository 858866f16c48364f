import random

from concord.operators.changes import apply_changes

COLUMNS = {"v": "double", "w": "string"}
OPS = "doc int, seq int, op string, name string, field string, value string, to string"


def one_by_one(records, ops):
    """The list applied to a dictionary of documents, change by change."""
    docs, out = {}, []
    for doc, name, v, w in records:
        docs.setdefault(doc, {})[name.lower()] = {"name": name, "v": v, "w": w}
    grouped = {}
    for o in ops:
        grouped.setdefault((o[0], o[1]), []).append(o)

    def fault(field, value):
        if field is None:
            return None
        if field not in COLUMNS:
            return "unknown field"
        try:
            if field == "v" and value is not None:
                float(value)
        except ValueError:
            return "unreadable"
        return None

    for (doc, _), rows in sorted(grouped.items()):
        held, (_, _, op, name, _, _, to) = docs.setdefault(doc, {}), rows[0]
        key = name.lower()
        faults = [fault(o[4], o[5]) for o in rows]
        reason = None
        if op == "add":
            reason = "exists" if key in held else None
        elif key not in held:
            reason = "no object"
        elif op == "rename" and to.lower() != key and to.lower() in held:
            reason = "exists"
        if reason is None and op == "update" and any(faults):
            faults = [f or "group refused" for f in faults]
        elif op in ("remove", "rename"):
            faults = [None] * len(rows)
        out += [(*o, reason or f) for o, f in zip(rows, faults) if reason or f]
        if reason or (op == "update" and any(faults)):
            continue
        if op == "remove":
            del held[key]
        elif op == "rename":
            held[to.lower()] = {**held.pop(key), "name": to}
        else:
            target = held.setdefault(key, {"name": name, "v": None, "w": None})
            for o, f in zip(rows, faults):
                if o[4] is not None and f is None:
                    target[o[4]] = float(o[5]) if o[4] == "v" and o[5] is not None else o[5]
    return sorted(((d, r["name"], r["v"], r["w"]) for d, held in docs.items() for r in held.values()), key=str), sorted(out, key=str)


def found(spark, records, ops, **more):
    df = spark.createDataFrame(records, "doc int, name string, v double, w string")
    after, rejects = apply_changes(df, spark.createDataFrame(ops, OPS), ["doc"], "name", COLUMNS, **more)
    return sorted(map(tuple, after.collect()), key=str), sorted(map(tuple, rejects.collect()), key=str)


def test_against_going_through_the_list(spark):
    rng, records, ops = random.Random(5), [], []
    for doc in range(12):
        records += [(doc, n, float(i), n) for i, n in enumerate("Ab")]
        for seq in range(40):
            op, name = rng.choice(["set-field", "update", "add", "remove", "rename", "rename"]), rng.choice("aAbBcd")
            to = rng.choice("abCD") if op == "rename" else None
            if op in ("remove", "rename"):
                ops.append((doc, seq, op, name, None, None, to))
            else:
                for field in rng.sample(["v", "w", "x"], 1 if op == "set-field" else rng.choice([1, 2])):
                    ops.append((doc, seq, op, name, field, rng.choice(["1", "2.5", "no", None]), None))
    expected = one_by_one(records, ops)
    assert {r[-1] for r in expected[1]} == {"exists", "no object", "unknown field", "unreadable", "group refused"}
    assert found(spark, records, ops) == expected
    assert found(spark, records, ops, width=7) == expected


def test_long_chain_of_renames_and_odd_rows(spark):
    chain = [(1, s, "rename", f"n{s}", None, None, f"N{s + 1}") for s in range(300)] + [(1, 300, "set-field", "n300", "w", "end", None)]
    odd = [(None, 1, "remove", "n0", None, None, None), (1, 301, "remove", None, None, None, None), (1, 302, "move", "n300", None, None, None)]
    after, rejects = found(spark, [(1, "n0", 1.0, "a"), (2, "n0", 2.0, "b"), (None, "x", 0.0, "c")], chain + odd)
    assert after == sorted([(1, "N300", 1.0, "end"), (2, "n0", 2.0, "b"), (None, "x", 0.0, "c")], key=str)
    assert sorted(r[-1] for r in rejects) == ["no object", "no object", "unknown op"]
    assert found(spark, [], []) == ([], [])


def test_names_of_few_events_are_not_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr("concord.operators.changes.blocked_running", None)
    ops = [(1, 1, "rename", "a", None, None, "b"), (1, 2, "set-field", "B", "v", "2", None), (1, 3, "remove", "a", None, None, None)]
    after, rejects = found(spark, [(1, "a", 1.0, "x")], ops)
    assert after == [(1, "b", 2.0, "x")] and [r[-1] for r in rejects] == ["no object"]
