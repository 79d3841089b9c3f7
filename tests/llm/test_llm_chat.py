import hashlib

from pageflow.llm import chat_format as chat

ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi </s> [INST]"), (1, 2, "assistant", "yo\\</s>"), (1, 3, "user", "\\"), (1, 4, "assistant", ""), (1, 5, "user", "left over <<SYS>>"),
    (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 0, None, "x\ny"), (3, None, "tool é", "<<ROLE:41>>\\\\<</SYS>>"), (None, 0, "user", "🙂"), (None, 1, "assistant", "ok <s>[/INST]"),
    (4, 0, "", ""), (5, 0, "user", "word " * 20000), (5, 1, "assistant", "<" * 3000 + "</s>" * 500),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, pos int, piece string")


def plain(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    stream = chat.formatted(frame(spark, ROWS)).cache()
    got = {r[0]: tuple(r)[1:5] for r in chat.digests(chat.read_back(stream)).collect()}
    assert got == plain(ROWS)


def test_examples_are_prefixes_with_one_reply(spark):
    stream = chat.formatted(frame(spark, ROWS)).cache()
    made = chat.examples(stream).collect()
    replies = [r for r in ROWS if r[2] == "assistant"]
    assert len(made) == len(replies)
    one = sorted((r for r in made if r["conv_id"] == 1), key=lambda r: r["example"])
    assert one[0]["text"] == r"<<SYS>>be brief</s>[INST]hi \</s> \[INST]</s>[/INST]yo\\\</s></s>"
    assert one[1]["text"].startswith(one[0]["text"]) and one[1]["text"].endswith("[INST]\\\\</s>[/INST]</s>")
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in one] == [r"yo\\\</s>", ""]
    assert all(r["text"].endswith("</s>") and r["loss_end"] + 4 == len(r["text"]) for r in made)


def test_empty_table(spark):
    assert chat.digests(chat.read_back(chat.formatted(frame(spark, []).limit(0)))).count() == 0


def test_query_holds_the_probe(spark, sf_dir):
    rows = {r["conv_id"]: r for r in chat.query(spark, sf_dir).collect()}
    assert rows[-1]["n_turns"] == 2 and rows[-1]["loss_chars"] == len(chat.PROBE)
    assert rows[-1]["loss_sha256"] == hashlib.sha256(chat.PROBE.encode()).hexdigest()


def test_the_query_writes_examples_and_reads_them(spark, tmp_path, monkeypatch):
    """What the query stores are whole examples, one per reply, and its rows come from their texts and masks."""
    frame(spark, ROWS).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    kept = []
    write = chat.written
    monkeypatch.setattr(chat, "written", lambda df, *a: kept.append(write(df, *a)) or kept[-1])
    got = {r[0]: tuple(r)[1:5] for r in chat.query(spark, str(tmp_path)).collect()}
    probe = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    assert got == plain(ROWS + probe)
    rows = [r for k in kept for r in k.collect()]
    made = [r for r in rows if r["example"] is not None]
    assert len(made) == sum(r[2] == "assistant" for r in ROWS + probe)
    one = sorted((r for r in made if r["conv_id"] == 1), key=lambda r: r["example"])
    assert one[0]["text"] == r"<<SYS>>be brief</s>[INST]hi \</s> \[INST]</s>[/INST]yo\\\</s></s>" and one[1]["text"].startswith(one[0]["text"])
    assert [r["text"] for r in rows if r["conv_id"] == 1 and r["example"] is None] == [r"[INST]left over \<<SYS>></s>"]
