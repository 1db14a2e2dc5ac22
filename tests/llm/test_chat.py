import hashlib
import json

from opinaria.llm.chat import Registry, canonical_turns, conversation_digests, format_turns, paths_of, read_back

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 3}, "messages", [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "system": "s"}, "conversations",
     [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": "o", "score": 1.5}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "c", "meta": {"a": [1, {"b": 2}]}}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c"}, "prompt_response", [("user", "p"), ("assistant", "c")]),
    ({"data": {"prompt": "p", "reply": "c"}}, "nested_data", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"turn": 1, "role": "system", "text": "t"}, "row", [("system", "t")]),
    ({"turn": 1, "role": "system", "text": None}, "row", [("system", "")]),
    ({"messages": []}, "messages", [(None, None)]),
    ({"other": 1}, None, [(None, None)]),
]


def test_paths_and_fingerprints():
    assert paths_of({"a": {"b": 1, "c": None}, "d": [{"e": 1}, {"f": [2]}], "g": []}) == {"a.b", "d[]", "d[].e", "d[].f[]", "g[]"}
    registry = Registry()
    one, _ = registry.select({"prompt": "x", "completion": "y", "id": 1})
    two, _ = registry.select({"completion": "q", "prompt": ""})
    assert one == two != registry.select({"prompt": "x"})[0]


def test_layouts_become_turns(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(100, None), (101, "[1]"), (102, "{broken")]
    records = spark.createDataFrame([(*r, "x") for r in rows], "id long, record string, role string")
    got = {}
    for r in sorted(canonical_turns(records).collect(), key=lambda r: (r.id, r.turn_in_record or 0)):
        got.setdefault(r.id, (r.layout, []))[1].append((r.role, r.text))
    assert got == {k: (name, turns) for k, (_, name, turns) in enumerate(RECORDS)} | {k: (None, [(None, None)]) for k in (100, 101, 102)}
    assert canonical_turns(records.limit(0)).collect() == []


TEXTS = ["", None, "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<", "|", "<|<||>", "a\nb\n", "ü😀<|", "\\", "<|im_end|>\n" * 3]


def test_template_is_reversible(spark):
    rows = [(k, role, t) for k, (role, t) in enumerate((r, t) for r in ("user", "assistant", None, "od<|d\\n\nrole\\") for t in TEXTS)]
    got = format_turns(spark.createDataFrame(rows, "id long, role string, text string")).collect()
    for r in got:
        assert read_back(r.formatted) == [(r.role or "", r.text or "")]
        assert (r.loss_start is not None) == (r.role == "assistant")
    whole = "".join(r.formatted for r in got)
    assert read_back(whole) == [(r.role or "", r.text or "") for r in got]
    for control in ("<|im_start|>", "<|im_end|>"):
        assert whole.count(control) == len(rows)


def test_digests_stream_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(c, t, "assistant" if t % 2 else "user", TEXTS[(c + t) % len(TEXTS)]) for c in range(12) for t in range(3 * c + 1)] + [(None, 0, "user", "x")]
        df = format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
        got = {r.conv_id: r for r in conversation_digests(df, "conv_id", ["turn"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 13
    for conv, r in got.items():
        turns = [x for x in rows if x[0] == conv]
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
    assert conversation_digests(df.limit(0), "conv_id", ["turn"]).collect() == []
