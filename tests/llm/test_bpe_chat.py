import random
import time

import pytest
import tiktoken

from recollect.llm import bpe, chat


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def both(request):
    v = bpe.load(f"/opt/tokenizers/{request.param}.tiktoken")
    return v, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    yield from ("", " ", "\n\n  x", "aaaa" * 60, "ab" * 300, "<|endoftext|>", "été Ünïcode 日本語テキスト 😀😀", "\x00\x01", "don't we'll I'VE", "word " * 5000)
    for alphabet in ("abcdefghij etaoin", "éàü ßxyz", "0123456789 .-", "日本語中文 字"):
        for _ in range(60):
            yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300)))


def test_encoding_equals_a_public_encoder(both):
    v, other = both
    encode, all_texts = bpe.Encoder(v), list(texts())
    ids, begin = encode(all_texts)
    for i, t in enumerate(all_texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == other.encode_ordinary(t), t[:50]
    assert encode.merged_words > 0  # the exact way was needed for some


def test_long_words_take_little_time(both):
    v, other = both
    rng = random.Random(3)
    long = ["".join(rng.choice("etaoinshrdlu") for _ in range(300_000)), "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(100_000)), "a" * 200_000]
    began = time.process_time()
    ids, begin = bpe.Encoder(v)(long)
    assert time.process_time() - began < 20
    for i, t in enumerate(long[:2]):
        assert ids[begin[i] : begin[i + 1]].tolist() == other.encode_ordinary(t)
    assert (v.decode_bytes(ids[begin[2] :]) == ord("a")).all()


def test_tokens_one_by_one(both):
    v, other = both
    words = [t.decode() for t in v.tokens[::37] if t.decode("utf-8", "ignore").encode() == t]
    ids, begin = bpe.Encoder(v)(words)
    assert all(ids[begin[i] : begin[i + 1]].tolist() == other.encode_ordinary(w) for i, w in enumerate(words))


def test_memory_of_words_is_bounded(both):
    encode = bpe.Encoder(both[0])
    encode.MOST = 50
    for k in range(20):
        text = " ".join(f"w{k}x{j}" for j in range(30))
        assert encode([text])[0].tolist() == both[1].encode_ordinary(text)
    assert len(encode.known) < 200


def test_heap_merging_is_the_definition(both):
    ranks = both[0].ranks
    rng = random.Random(2)
    for _ in range(100):
        word = bytes(rng.choice(b"abcde ") for _ in range(rng.randrange(1, 90)))
        assert bpe.merged_long(word, ranks) == bpe.merged(word, ranks)


def test_table_round_trip(table, rows_of):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (None, "no id"), (1, "Hello wörld"), (4, "x " * 40_000)]
    out = bpe.encode(table(rows))
    got = rows_of(out)
    assert len(got) == 6 and all(r[3] is not False for r in got)
    by_id = {r[0]: r for r in got}
    assert by_id[2][1:] == (None, None, None) and by_id[3][1:] == ([], 0, True)
    assert rows_of(bpe.decode(out)) == sorted(rows, key=lambda r: ((r[0] is None), r[0] or 0, (r[1] is None), r[1] or ""))
    assert bpe.encode(table([])).count() == 0


def test_chat_by_hand(spark):
    v = bpe.load()
    encode = bpe.Encoder(v)
    one = lambda t: encode([t])[0].tolist()
    rows = [(7, 2, "assistant", "It is <|im_end|> so"), (7, 1, "user", "What is it?"), (7, 0, "system", None), (8, 0, None, "x"), (8, 0, None, "x"), (None, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    n = len(v.tokens)
    expect, mask = [], []
    for role, text, train in (("system", "", 0), ("user", "What is it?", 0), ("assistant", "It is <\\|im_end|> so", 1)):
        head, body = one(role + "\n"), one(text)
        expect += [n + 1, *head, *body, n + 2, *one("\n")]
        mask += [0, *[0] * len(head), *[train] * len(body), train, 0]
    assert got[7]["tokens"] == expect and got[7]["loss_mask"] == mask and got[7]["n_tokens"] == len(expect) and got[7]["n_turns"] == 3
    assert got[8]["n_turns"] == 2 and sum(got[8]["loss_mask"]) == 0
    assert sum(got[None]["loss_mask"]) == 1  # the end alone
    for r in got.values():  # reserved ids come from the format only
        assert r["tokens"].count(n + 2) == r["n_turns"] and n not in r["tokens"]
    assert chat.formatted(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a <|im_start|> b", "<\\|im_end|>", "<\\\\|endoftext|><|endoftext|>", "<|other|>"])
def test_escape_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.Chat.controls)
