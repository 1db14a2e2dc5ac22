import hashlib
import itertools
import random
import re
import zlib

from opinaria.llm import repair as R

GRAMMAR = re.compile("(s?(ua)+)?")
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_force(rows):
    """(cost, audit, repaired) of the best of all edit sequences with at most two inserts in a row."""
    best = None
    marks = faults(rows)
    edits = [[("D", 4, None)] + ([] if f in ("blank", "duplicate") else [
        ("K", 3 * (f == "truncated"), (r, t)), ("R", 3 + 3 * (f == "truncated"), ("user", t)), ("R", 3 + 3 * (f == "truncated"), ("assistant", t))])
        for (r, t), f in zip(rows, marks)]
    inserts = [x for n in range(3) for x in itertools.product([("I", 3, ("user", "")), ("I", 3, ("assistant", ""))], repeat=n)]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        if sum(map(len, gaps)) > 4:
            continue
        for chosen in itertools.product(*edits):
            path = [e for gap, edit in itertools.zip_longest(gaps, chosen) for e in [*gap, *([edit] if edit else [])]]
            out = [e[2] for e in path if e[2]]
            if all(r for r, _ in out) and GRAMMAR.fullmatch("".join(r[0] for r, _ in out)):
                found = (sum(e[1] for e in path), "".join(e[0] for e in path), out)
                best = min(best or found, found)
    return best


def simple(rows):
    """The same by tuples (cost, letters, repaired) per state, for long conversations."""
    states = {"": (0, "", [])}
    def inserted(states):
        for _ in range(2):
            for q, (c, a, o) in list(states.items()):
                to = "a" if q == "u" else "u"
                new = (c + 3, a + "I", o + [("assistant" if to == "a" else "user", "")])
                states[to] = min(states.get(to, new), new)
        return states
    for (role, text), f in zip(rows, faults(rows)):
        after = {}
        for q, (c, a, o) in inserted(dict(states)).items():
            extra = 3 * (f == "truncated")
            steps = [(q, (c + 4, a + "D", o))]
            if f not in ("blank", "duplicate"):
                to = "a" if q == "u" else "u"
                steps.append((to, (c + 3 + extra, a + "R", o + [("assistant" if to == "a" else "user", text)])))
                if (role[:1], q) in {("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")}:
                    steps.append((role[0], (c + extra, a + "K", o + [(role, text)])))
            for to, new in steps:
                after[to] = min(after.get(to, new), new)
        states = after
    final = inserted(dict(states))
    return min(final[q] for q in ("", "a") if q in final)


def one_path(rows):
    fold = R.Fold()
    codes = [(r[:1], {"": R.FINE, "blank": R.BLANK, "duplicate": R.DUPLICATE, "truncated": R.CUT}[f]) for (r, _), f in zip(rows, faults(rows))]
    for k in range(0, len(codes), 3):
        part = codes[k : k + 3]
        cells = [None if w is None else w.to_bytes(w.bit_length() // 8 + 1, "big") for s in range(4) for w in R.block_weights(part, s)]
        fold.add(len(part), cells, [0] * 4, 0, part[0][0], part[-1][0], None, None, 0)
    return fold.audit()


ROLES, TEXTS = ["user", "assistant", "system", "tool", "", " ", "u"], ["Ok.", "and", "", " \n", "Why? ", "No"]


def test_blocks_equal_brute_force():
    draw = random.Random(1)
    for _ in range(250):
        rows = [(draw.choice(ROLES[:4]) if draw.random() < 0.8 else draw.choice(ROLES), draw.choice(TEXTS)) for _ in range(draw.randint(0, 3))]
        want = brute_force(rows) if rows else (0, "", [])
        assert one_path(rows) == want[:2] == simple(rows)[:2] if rows else one_path(rows) == (0, "")
    for _ in range(400):
        rows = [(draw.choice(ROLES), f"{draw.choice(TEXTS)}{draw.choice(TEXTS)}") for _ in range(draw.randint(4, 40))]
        assert one_path(rows) == simple(rows)[:2]


def crc_damage(rows):
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if mark:
            text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
            yield from [(conv, turn, "user" if mark == 4 else role, text)] * (1 + (mark == 3))


def expected(rows, ids):
    out = []
    for conv in ids:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in mine if t is not None]
        said = [(r, t) for _, r, t in mine]
        marks = faults(said)
        cost, audit, repaired = simple(said)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


def table(spark):
    draw = random.Random(2)
    rows = [(c, t if draw.random() < 0.9 else None, draw.choice(ROLES + [None]), draw.choice(TEXTS + ["é😀.", None]), "x") for c in range(80) for t in range(draw.randint(1, 12))]
    rows += [(None, t, "user", "Hi.", None) for t in range(4)]
    rows += [(500, t // 2, draw.choice(ROLES[:3]), draw.choice(["Ok.", "and", str(t) + "!"]), "x") for t in range(1500)]
    rows += [(501, 3, "user", "word " * 30_000, "x"), (501, 4, "assistant", "word. " * 30_000, "x")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").repartition(6)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_repair_equals_the_definition(spark):
    rows, df = table(spark)
    got = [tuple(r) for r in R.repair(R.damage(df), ids=df).collect()]
    want = expected(list(crc_damage([r[:4] for r in rows])), {r[0] for r in rows})
    assert sorted(got, key=key) == sorted(want, key=key)


def test_without_damage_and_extra_columns(spark):
    rows, df = table(spark)
    plain = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, _ in rows]
    got = [tuple(r) for r in R.repair(df.withColumnRenamed("conv_id", "pos"), conv_col="pos").collect()]
    assert sorted(got, key=key) == sorted(expected(plain, {r[0] for r in rows}), key=key)


def test_string_ids_empty_tables_and_clean_rows(spark):
    clean = spark.createDataFrame([("a", 1, "system", "Be kind."), ("a", 2, "user", "Why?"), ("a", 3, "assistant", "So.")], "conv_id string, turn int, role string, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r)[:8] for r in R.repair(clean).collect()] == [("a", 0, 0, 0, 0, 0, 0, "KKK")]
    assert R.repair(clean.limit(0)).collect() == []
    assert [tuple(r) for r in R.repair(clean.limit(0), ids=clean).collect()] == [("a", 0, 0, 0, 0, 0, 0, "", nothing)]
    assert R.damage(clean.limit(0)).collect() == []
