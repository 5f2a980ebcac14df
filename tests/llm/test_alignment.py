"""Cross-tokenizer alignment against a plain version over both tokenizers' own libraries, and awkward texts."""

import hashlib
import random
from collections import Counter

import pytest

from rowloom.llm import alignment, queries

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SHAPE = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = alignment._byte_of_letter()

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, two.id_to_piece(i)) for i in two.encode(text))]
        raw = b" " + text.encode()
        return (a, b) if b"".join(p for _, p in a) == raw == b"".join(p for _, p in b) else ([], [])

    return tokens


def brute(plain, rows):
    """Byte by byte: where both end, and what each ends with."""
    linked, found = Counter(), []
    for doc_id, text in rows:
        a, b = plain(text)
        ends = []
        for side in (a, b):
            at, own = 0, {}
            for i, p in side:
                at += len(p)
                own[at] = i
            ends.append(own)
        groups, links, start = [], [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            part = [[own[e] for e in sorted(own) if start < e <= end] for own in ends]
            groups.append("|".join(",".join(map(str, p)) for p in part))
            links.append((ends[0][end], ends[1][end]))
            start = end
        linked.update(links)
        overlaps = len(set(ends[0]) | set(ends[1]))
        found.append((doc_id, len(a), len(b), groups, links, overlaps))
    most = {}
    for (_, j), n in linked.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for doc_id, n_a, n_b, groups, links, overlaps in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        products = sum((g.split("|")[0].count(",") + 1) * (g.split("|")[1].count(",") + 1) for g in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(linked[x] == most[x[1]] for x in links), sum(linked[x] for x in links), sha, overlaps, products))
    return sorted(out, key=repr)


def ours(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_products"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_query_agrees(spark, sf, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op12_alignment(spark, sf)
    assert [c for c, _ in df.dtypes][:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ours(df) == brute(plain, rows)


def awkward():
    draw = random.Random(4)
    texts = [None, "", " ", "  ", "\n\n\t x", "a▁b", "<|endoftext|> </s> <unk><0x0A>", "\x00\x01", "café 日本語 \U0001f600‍", "éﬁ 　", "1234567 3.14", "x" * 5000, "it's we'll I'D", "\r\n \r"]
    texts += ["".join(chr(draw.choice([*range(32, 127), *range(0xC0, 0x180), *range(0x4E00, 0x4E40), 0x1F600, 0x2028, 9, 10, 0x85])) for _ in range(draw.randrange(1, 200))) for _ in range(40)]
    return [*enumerate(texts), (None, "the same row"), (None, "the same row"), (3, "  ")]


@pytest.mark.parametrize("chunk", [1, 64, 1 << 20])
def test_awkward_texts(spark, plain, chunk):
    rows = awkward()
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    kept = alignment.CHUNK
    a, b = alignment.byte_level(A), alignment.piece_level(B)
    whole = alignment.align(a, b, [t for _, t in rows])
    try:
        alignment.CHUNK = chunk
        assert ours(alignment.align_documents(df, A, B, ["doc_id"])) == brute(plain, rows)
    finally:
        alignment.CHUNK = kept
    for (_, text), s, e in zip(rows, whole.a_of[:-1], whole.a_of[1:], strict=True):
        assert whole.a[s:e].tolist() == [i for i, _ in plain(text)[0]]


def test_no_rows_and_no_tokens(spark):
    assert alignment.align_documents(spark.createDataFrame([], SHAPE), A, B, ["doc_id"]).collect() == []
    assert ours(alignment.align_documents(spark.createDataFrame([(1, None), (2, "")], SHAPE), A, B, ["doc_id"])) == [(i, *[0] * 6, "", 0, 0) for i in (1, 2)]


def test_groups(spark, plain):
    rows = [(1, "tokenization aligns"), (2, None), (3, "日 x")]
    for r in alignment.aligned_groups(spark.createDataFrame(rows, SHAPE), A, B, ["doc_id"]).collect():
        a, b = plain(dict(rows)[r.doc_id])
        assert [i for g in r.groups for i in g.a] == [i for i, _ in a] and [i for g in r.groups for i in g.b] == [i for i, _ in b]
        assert not r.groups or r.groups[-1].end == len(dict(rows)[r.doc_id].encode()) + 1


def test_a_file_whose_ids_are_not_ranks_is_refused():
    with pytest.raises((ValueError, KeyError)):
        alignment.byte_level("/opt/tokenizers/word_bpe_49k.json")


def test_other_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([("p", 1, "some words", 7)], "name string, part int, text string, n_a int")
    assert tuple(alignment.align_documents(df, A, B, ["name", "part"]).first())[:2] == ("p", 1)
