import hashlib
import random
import zlib
from fractions import Fraction

from opinaria.llm.periodic_runs import collapsed, periodic_runs, repeat_words, run_digests, runs_of, without_runs


def brute_force(words):
    """All runs by the definition: every maximal stretch of every period, the smallest period only."""
    n, out = len(words), []
    for q in range(1, n + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(24, 3 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(draw):
    words = [draw.choice("abcdefgh"[: draw.randint(1, 8)]) for _ in range(draw.randint(0, 60))]
    for _ in range(draw.randint(0, 3)):
        block = [draw.choice("abcxyz") for _ in range(draw.randint(1, 30))]
        at = draw.randint(0, len(words))
        words[at:at] = (block * draw.randint(2, 9))[draw.randint(0, 5) :]
    if draw.random() < 0.3:
        unit = (["a"] * draw.randint(1, 30) + ["b"]) * 3
        words += unit * draw.randint(1, 4)
    return words


def test_runs_equal_brute_force():
    draw = random.Random(5)
    texts = [random_words(draw) for _ in range(500)]
    for words, runs in zip(texts, runs_of(texts)):
        assert runs == brute_force(words), words
    assert sum(map(bool, runs_of(texts))) > 200


def test_binary_noise_and_one_word():
    draw = random.Random(6)
    noise = [draw.choice("ab") for _ in range(700)]
    assert runs_of([noise])[0] == brute_force(noise)
    assert runs_of([["x"] * 5000])[0] == [(0, 5000, 1)]
    assert runs_of([["x"] * 23])[0] == []
    assert runs_of([[], ["x"] * 24]) == [[], [(0, 24, 1)]]
    long = [str(k) for k in range(4000)] * 3
    assert runs_of([long])[0] == [(0, 12000, 4000)]


def test_collapse_keeps_the_first_period():
    assert collapsed(list("zabcabcabc"), [(1, 9, 3)]) == list("zabc")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark):
    draw = random.Random(7)
    rows = [(k, " ".join(random_words(draw)), "x") for k in range(150)]
    rows += [(1, rows[1][1], "x"), (None, "a " * 30, None), (900, None, None), (901, "", "y"), (902, " \t\n", "y"),
             (903, "é b " * 40 + " ", "y"), (904, "w " * 40_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = run_digests(docs, plant=True).collect()
    want = []
    for doc, text, _ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h = None if doc is None else zlib.crc32(str(doc).encode())
        if h is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_force(words) if len(words) < 1000 else [(0, len(words), 1)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
                     digest(" ".join(w for i, w in enumerate(words) if i not in dropped))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 40
    assert run_digests(docs.limit(0)).collect() == []


def test_general_interface(spark):
    rows = [(1, "z " + "a b " * 12 + "z", 5), (2, None, 5), (3, "no  run", 5), (1, "z " + "a b " * 12 + "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period int")
    assert [tuple(r) for r in periodic_runs(docs).collect()] == [(1, 1, 24, 2)] * 2
    assert [tuple(r) for r in without_runs(docs).orderBy("period", "doc_id").collect()] == [(1, "z a b z", 5), (2, None, 5), (3, "no  run", 5), (1, "z a b z", 6)]
    assert without_runs(docs).schema == docs.schema


def test_planting_is_the_stated_rule():
    words = list("abcdefghijklmnopqrstuvwxyz")
    assert repeat_words(words, 1) == words and repeat_words(words, None) == words and repeat_words([], 10) == []
    g = 57
    a, p = g % 26, 1 + (26 - g % 26) // (3 + g % 8)
    assert repeat_words(words, 10 * g) == [words[i] if i < a else words[a + (i - a) % p] for i in range(26)]
