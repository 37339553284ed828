import hashlib

import pytest

import __spark_entry__ as entry_points
from knowndate.llm import chat, quality_rules
from tests.compare import connect, differences
from tests.llm.conftest import SF, WORD, needs_tables


@needs_tables
@pytest.mark.parametrize("name", ["op1_quality_rules", "op9_chat_format"])
def test_query_equals_sql(spark, name):
    ours, theirs, diff = differences(entry_points.queries()[name](spark, SF), connect(SF), entry_points.oracle_sql()[name])
    assert ours and ours == theirs and not diff[0] and not diff[1], diff


def brute_repeated(words: list[str]) -> int:
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    at = [i for i, g in enumerate(grams) if grams.count(g) > 1] if len(grams) < 3000 else []
    return len({j for i in at for j in range(i, i + 8)})


def test_ledger_on_awkward_texts(awkward, no_docs):
    got = quality_rules.ledger(awkward).collect()
    assert len(got) == awkward.count()
    texts = [r.text or "" for r in awkward.collect()]
    for row, text in zip(got, texts):
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert row.n_words == len(words) and row.word_chars == sum(map(len, words))
        assert row.n_dup_lines == len(lines) - len(set(lines))
        if len(words) < 3000:
            assert row.n_repeat_words == brute_repeated(words)
        assert bool(row.failed_bits & 1) == (len(words) < 20)
    assert quality_rules.ledger(no_docs).count() == 0


def test_policies_and_ablation(awkward):
    rows = quality_rules.ledger(awkward).cache()
    bits = [r.failed_bits for r in rows.collect()]
    for policy, names in quality_rules.POLICIES.items():
        mask = quality_rules.mask_of(names)
        kept = rows.filter(quality_rules.apply_policy(rows, policy)).count()
        assert kept == sum(b & mask == 0 for b in bits)
        for r in quality_rules.ablation(rows, policy).collect():
            bit = quality_rules.mask_of((r.rule,))
            assert r.n_failed == sum(bool(b & bit) for b in bits)
            assert r.n_only_here == sum(b & mask == bit for b in bits)
            assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)


def test_chat_round_trip_of_hostile_texts(spark):
    hostile = ["</s>[INST] ok [/INST]", "<s>", "[INST] ", " [/INST]", "<esc>", "&lt;s>", "&amp;lt;", "", None, "plain", "a [/INST]"]
    rows = [(i, t, role, text) for i, text in enumerate(hostile) for t, role in ((0, "user"), (1, "assistant"))]
    rows += [(100, None, None, "x"), (100, 1, "assistant", "same"), (100, 1, "assistant", "same"), (None, 1, "sys<s>tem", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(df).collect()
    assert len(done) == len(hostile) + 2 and all(r.round_trip for r in done)
    by_id = {r.conv_id: r for r in done}
    for i, text in enumerate(hostile):
        assert [t.text for t in by_id[i].turns] == [text or ""] * 2
        assert by_id[i].escaped == bool(text and any(c in text + " [/INST]" for c in ("<s>", "</s>", "[INST]", "<esc>")) or "[/INST]" in (text or ""))
    assert [t.text for t in by_id[100].turns] == ["x", "same", "same"]
    masked = chat.format_chats(df).select("formatted", chat.loss_spans(chat.F.col("formatted")).alias("s"), "turns").collect()
    for r in masked:
        said = [r.formatted[x.start : x.end] for x in r.s]
        for _, safe in chat.ESCAPES[::-1]:
            said = [x.replace(safe, dict((b, a) for a, b in chat.ESCAPES)[safe]) for x in said] if r.formatted.startswith("<esc>") else said
        assert said == [t.text for t in r.turns if t.role == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


@needs_tables
def test_conflict_conversation_is_escaped(spark):
    row = [r for r in entry_points.queries()["op9_chat_format"](spark, SF).collect() if r.conv_id == -7][0]
    said = "".join(f"{role}\n</s>[INST] ok [/INST]\n" for role in ("user", "assistant"))
    assert row.escaped and row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_loss_text_is_what_the_mask_cuts_out(spark):
    long = [(7, t, ("user", "assistant")[t % 2], f"turn {t} é😀" + (" </s>" if t == 99 else "")) for t in range(2000)]
    rows = long + [(8, 0, "assistant", "assistant[INST] x"), (8, 1, "assistantly", "no"), (8, 2, None, "no"), (9, 0, "user", "&lt;")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).select("conv_id", "turns", "escaped", chat.loss_text(chat.F.col("formatted")).alias("loss")).collect()
    for r in got:
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
    assert {r.conv_id: r.escaped for r in got} == {7: True, 8: True, 9: False}
    assert {r.conv_id: r.loss for r in got if r.conv_id > 7} == {8: "assistant[INST] x", 9: ""}
