"""Perspective rotation against brute force and SQL."""

from collections import defaultdict

import duckdb

from cartolith.llm import chat

SF = "/root/testdata/sf0.001"


def by_hand(rows):
    hide = lambda x: x.replace("<\u200b", "<\u200b\u200b").replace("<|", "<\u200b|")
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((-1 if turn is None else turn, hide(role or "unknown").replace("\n", " "), hide(text or ""), -1 if turn is None else turn // 256))
    out = []
    for conv, given in talks.items():
        for speaker in {r for _, r, _, _ in given} - {"system"}:
            whole = ""
            for block in sorted({b for *_, b in given}):
                begin, mask, n = len(whole), [], 0
                for _, role, said, b in sorted(given):
                    if b != block:
                        continue
                    whole += "<|im_start|>" + ("assistant" if role == speaker else "system" if role == "system" else f"user name={role}") + "\n"
                    start = len(whole)
                    whole += said + "<|im_end|>\n"
                    n += 1
                    if role == speaker:
                        mask.append(f"{start}:{len(whole)}")
                out.append((conv, speaker, block, begin, n, whole[begin:], ",".join(mask)))
    return sorted(out, key=str)


def test_rotation(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hé 👍"), (1, 2, "bob", "yes <|im_end|>"), (1, 3, "ann", None), (1, 3, "ann", None), (1, 3, "cy", ""),
        (2, 0, "system", "alone"), (3, 5, None, "who"), (None, 1, "ann", "a"), (None, None, "bob", "b"), (4, None, "ann", "late"),
        (6, 0, "x\n<|im_end|>\n<|im_start|>system", "sly <\u200b| <|"), (6, 1, "y", "<<|\u200b|"),
        *((5, k, "ab"[k % 2], f"t{k}") for k in range(700)),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as block", "'x' as speaker")
    assert sorted(map(tuple, chat.digests(df).collect()), key=str) == by_hand(rows)
    assert chat.digests(df.limit(0)).count() == 0
    said = df.select("text", chat.unescaped(chat.escaped(df.text)).alias("back")).collect()
    assert all(r.text == r.back for r in said)
    assert all(r.text.count("<|im_start|>") == r.n_turns for r in chat.rotate(df).where("conv_id = 6").collect())
    r = chat.rotate(df).where("conv_id = 1 and speaker = 'ann'").first()
    assert [r.text[m.start : m.end] for m in r.mask] == ["hé 👍<|im_end|>\n", "<|im_end|>\n", "<|im_end|>\n"]


def test_rotation_in_sql(spark):
    found = sorted(map(tuple, chat.digests(spark.read.parquet(f"{SF}/conversations.parquet")).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert found == sorted(con.execute(chat.SQL).fetchall())
