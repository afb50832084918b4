"""Token files."""

import random
import zlib

import numpy as np
import pytest

from lexigraf.llm import token_files

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_words_encode_as_whole_texts(rows):
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER, 0)
    odd = ["", "  a", " a", "a ", "a  b c", "a\n b", "a \nb", "é  ñ", "<|endoftext|> a b", "a b<|endoftext|>", "it's 'll we 've", "a\tb c\t d", " ", "　a b", "a  b c", "a  b c", "x\x1f y z", "a b\x85 c"]
    for text in [*odd, *[t or "" for _, t, *_ in rows]]:
        assert token_files.widen(enc(text), enc.width) == np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes(), repr(text)


def test_token_files_round_trip(spark, docs, rows, empty, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    files = token_files.write_tokens(docs, TOKENIZER, folder)
    got = token_files.read_tokens(files, folder).collect()
    enc = token_files.encoder(TOKENIZER, 0)
    at, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = token_files.widen(enc(t or ""), enc.width)
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    fs, base = token_files.place(folder)
    name = files.orderBy("path").first()["path"]
    dictionary = (tmp_path / "tokens/dictionary.zstd").read_bytes()
    inside = list(token_files.read_shard(fs, f"{base}/{name}", dictionary))
    for k in (0, len(inside) // 2, len(inside) - 1):
        assert token_files.read_document(fs, f"{base}/{name}", dictionary, k) == inside[k][1]
    with pytest.raises(ValueError):
        token_files.read_document(fs, f"{base}/{name}", b"other", 0)
    other = f"file://{tmp_path}/none"
    assert token_files.read_tokens(token_files.write_tokens(empty, TOKENIZER, other), other).count() == 0


def test_token_files_of_clashing_columns(spark, docs, clashing, tmp_path):
    outs = []
    for name, frame in (("a", docs), ("b", clashing)):
        folder = f"file://{tmp_path}/{name}"
        outs.append(sorted(repr(tuple(r)) for r in token_files.read_tokens(token_files.write_tokens(frame, TOKENIZER, folder), folder).collect()))
    assert outs[0] == outs[1]


def test_new_words_are_learnt_as_the_tokenizer_cuts_them():
    """Random words of letters, digits, marks, line ends and other scripts, alone and in batches, with a small cache."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    whole, enc = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER, 0)
    parts = ["ab", "Zü", "é", "9", "42", ".", ",", "***", "'s", "'", "\n", "\n\n", "\t", "-", "ß", "中文", "ﬁ", "ª", "²", "…", "Ж", "\u0301", "_", "x\u00a0y"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(1, 12))) for _ in range(800)]
    want = [np.array([*whole.encode(t, add_special_tokens=False).ids, 0], enc.kind).tobytes() for t in texts]
    assert enc.many(texts) == want and [enc(t) for t in texts] == want
    small = token_files.Encoder(TOKENIZER, 0)
    token_files.CACHED, kept = 50, token_files.CACHED
    try:
        assert [x for i in range(0, 800, 10) for x in small.many(texts[i : i + 10])] == want
    finally:
        token_files.CACHED = kept
