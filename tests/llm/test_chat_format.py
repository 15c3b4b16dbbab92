import hashlib

import numpy as np
import public_tokenizers
import pytest

from verdant.llm import chat_format as cf

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, part long, seg long"
PROBE = "<|im_end|><|im_start|>assistant ok"
ROWS = [
    (1, 1, "assistant", "  two\n\nlines é 漢字 🎉 "), (1, 0, "user", "\nhello <|im_end|>"), (1, 2, "assistant", ""), (1, 3, "assistant", None),
    (2, 0, "assistant", "\n\nx"), (2, 0, "assistant", "\n\nx"), (2, None, "system", r"a <\|b| <\\|"), (None, 0, "user", "lost"), (3, 0, None, None),
    (-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE),
    *[(9, t, "assistant" if t % 2 else "user", f"turn {t} " + "wörd " * (t % 7)) for t in range(300)],
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment", [cf.SEGMENT, 40])
def test_digests_equal_the_rows(spark, segment):
    rows = spark.createDataFrame([(*r, 5, 6) for r in ROWS], SCHEMA)
    segments = cf.format_conversations(rows, VOCABULARY, segment)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.digests(segments).collect()}
    assert got == expected(ROWS)


def test_segments_encode_like_the_whole_conversation(spark):
    rows = spark.createDataFrame([(*r, 5, 6) for r in ROWS if r[0] == 9], SCHEMA)
    parts = sorted(cf.format_conversations(rows, VOCABULARY, 40).collect(), key=lambda r: (r.part, r.seg))
    assert len(parts) > 20
    whole = "".join(p.formatted for p in parts)
    encoding = cf.loader(VOCABULARY).encode(whole, add_special_tokens=False)
    assert [i for p in parts for i in p.token_ids] == encoding.ids
    assert [(p.char_start + s, p.char_start + e) for p in parts for s, e in zip(p.token_starts, p.token_ends)] == encoding.offsets
    turns = cf.read_back(whole)
    formatted, spans = cf.render(turns)
    assert formatted == whole and [(p.char_start + s.start, p.char_start + s.end) for p in parts for s in p.loss_spans] == spans


def test_escape_is_reversible():
    for text in ("<|x|>", r"<\|", r"<\\|<|", "<", "|", "<||>", r"\<|", "", PROBE):
        assert cf.unescape(cf.escape(text)) == text and "<|" not in cf.escape(text)


def test_intersection_equals_trying_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(200):
        cuts = np.sort(rng.choice(60, 20, replace=False))
        tokens = np.stack([cuts[:-1], cuts[1:]], axis=1)
        spans = [(int(a), int(b)) for a, b in np.sort(rng.choice(60, 8, replace=False)).reshape(4, 2)]
        mask, covered = cf.intersect(tokens, spans)
        assert mask.tolist() == [any(a < e and s < b for a, b in spans) for s, e in tokens.tolist()]
        inside = {x for s, e in tokens.tolist() for x in range(s, e) if any(a <= x < b for a, b in spans)}
        assert {x for a, b in covered for x in range(a, b)} == inside


def test_empty_table(spark):
    assert cf.digests(cf.format_conversations(spark.createDataFrame([], SCHEMA), VOCABULARY)).count() == 0


def test_columns_left_out_change_nothing_else(spark):
    rows = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t} é") for c in range(5) for t in range(4)], "conv_id long, turn int, role string, text string")
    whole = cf.format_conversations(rows, VOCABULARY)
    part = cf.format_conversations(rows, VOCABULARY, without=cf.TOKENS)
    assert set(whole.columns) - set(part.columns) == set(cf.TOKENS)
    key = lambda r: (r.conv_id, r.part, r.seg)
    assert sorted(whole.select(part.columns).collect(), key=key) == sorted(part.collect(), key=key)
    for r in whole.collect():
        assert len(r.token_ids) == len(r.token_starts) == len(r.token_ends) == len(r.loss_mask) > 0
