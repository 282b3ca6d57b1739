import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from caseloom.llm import alignment

pytestmark = pytest.mark.skipif(not Path(alignment.FOLDER).exists(), reason="vocabularies are not here")


@pytest.fixture(scope="module")
def plain():
    """The alignment token by token, with whole texts given to both tokenizers."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_BPE}")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECE_BPE}")
    letters = alignment._byte_letters()
    entries = {number: entry for entry, number in first.get_vocab().items()}

    def piece(number):
        text = second.id_to_piece(number)
        return bytes([int(text[3:5], 16)]) if second.is_byte(number) else text.replace("▁", " ").encode()

    def one(text):
        empty = (0, 0, 0, Counter(), "")
        if not text:
            return empty
        a, b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)
        data = [[bytes(letters[c] for c in entries[i]) for i in a], [piece(i) for i in b]]
        if any(b"".join(of) != f" {text}".encode() for of in data):
            return empty
        ends = [np.cumsum([len(d) for d in of]).tolist() for of in data]
        cuts, groups, links, i, j = sorted(set(ends[0]) & set(ends[1])), [], Counter(), 0, 0
        for cut in cuts:
            left, right = i, j
            i, j = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append(",".join(map(str, a[left:i])) + "|" + ",".join(map(str, b[right:j])))
            links.update((x, y) for x in a[left:i] for y in b[right:j])
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    def every(docs):
        found = [(doc_id, *one(text)) for doc_id, text in docs]
        held = Counter(pair for row in found for pair in row[4])
        top = {}
        for (a, _), n in held.items():
            top[a] = max(top.get(a, 0), n)
        rows = []
        for doc_id, n_a, n_b, n_groups, links, digest in found:
            best = sum(n for pair, n in links.items() if held[pair] == top[pair[0]])
            rows.append((doc_id, n_a, n_b, n_groups, sum(links.values()), best, sum(n * held[pair] for pair, n in links.items()), digest))
        return sorted(rows, key=repr)

    return every


ODD = [
    "a", " ", "  ", "a  ", "a \n  b\t c", "\n\n x", "<|endoftext|> <s> </s> <unk>", "co▁de", "é\u0301 ñandú 東京タワー 🤖🤖 \u200d",
    "x" * 3000, "aaaa " * 500, "\u0000\x1c  b\x85 c", "ﬁ ½ Å", "tail \n", "don't we'll 12345678 !!!???",
]


def rows_of(df):
    return sorted([tuple(row)[:8] for row in df.collect()], key=repr)


@pytest.mark.parametrize("max_pairs", [alignment.MAX_PAIRS, 3])
def test_odd_texts_like_token_by_token(spark, plain, messy, max_pairs):
    docs = [(100 + i, text) for i, text in enumerate(ODD)] + [(100, "a"), (None, "a  b")]
    more = messy.select("doc_id", "text").collect()
    df = messy.unionByName(spark.createDataFrame(docs, "doc_id long, text string"), allowMissingColumns=True).repartition(3)
    assert rows_of(alignment.align(df, max_pairs=max_pairs)) == plain([*map(tuple, more), *docs])


def test_random_texts(spark, plain):
    dice = random.Random(13)
    letters = " \n\t  abcdefghié東🤖\u00a0'.,1▁" + "etaoin" * 4
    docs = [(i, "".join(dice.choice(letters) for _ in range(dice.randrange(1, 90)))) for i in range(400)]
    assert rows_of(alignment.align(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)


def test_whole_table(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(alignment.align(docs)) == plain([(row["doc_id"], row["text"]) for row in docs.collect()])


def test_nothing(spark, nothing):
    assert rows_of(alignment.align(nothing)) == []


def test_products_like_dense_ones(monkeypatch):
    dice = np.random.default_rng(3)
    monkeypatch.setattr(alignment, "PRODUCTS", 7)
    for _ in range(20):
        left, right = dice.integers(0, 3, (6, 5)), dice.integers(0, 3, (5, 4))
        sparse = [alignment.csr(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in (left, right)]
        ends, columns, values = alignment.product(*sparse, 4)
        dense = np.zeros((6, 4), int)
        dense[np.repeat(np.arange(6), np.diff(ends)), columns] = values
        assert (dense == left @ right).all()


def test_overlaps_share_bytes():
    ends, columns, shared = alignment.overlaps(np.array([2, 3, 1]), np.array([1, 4, 1]))
    assert np.diff(ends).tolist() == [2, 1, 1]
    assert columns.tolist() == [0, 1, 1, 2] and shared.tolist() == [1, 1, 3, 1]


def test_tokens_are_forgotten_in_time(monkeypatch, spark, plain):
    docs = [(i, f"word{i} other{i % 7} ▁") for i in range(50)] + [(i, f"word{i} other{i % 7}") for i in range(50)]
    data = [Path(alignment.FOLDER, name).read_bytes() for name in (alignment.BYTE_BPE, alignment.PIECE_BPE)]
    known = alignment.Known(alignment.First(data[0]), alignment.Second(data[1]))
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    batches = [known.documents([i for i, _ in docs[s : s + 10]], [t for _, t in docs[s : s + 10]]) for s in range(0, 100, 10)]
    found = sorted([(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for b in batches for r in b.to_pylist()], key=repr)
    assert found == [(*row[:5], row[7]) for row in plain(docs)]
