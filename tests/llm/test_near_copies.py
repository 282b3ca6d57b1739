import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from caseloom.llm import decontaminate, paragraphs, simhash
from caseloom.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {n: find(n) for n in nodes}


def prose(dice, count):
    return [f"w{dice.randint(0, 400)}" for _ in range(count)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7), (None, 3), (300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_keys_meet():
    dice, patterns = random.Random(2), simhash.error_patterns()
    assert patterns[1].min() == 1 and patterns[1].max() == 6
    for _ in range(300):
        one = dice.getrandbits(64)
        two = one
        for bit in dice.sample(range(64), dice.randint(0, 3)):
            two ^= 1 << bit
        row, key, side = simhash.golay_keys(np.array([simhash.signed(one), simhash.signed(two)]), patterns)
        assert set(key[(row == 0) & (side == 0)]) & set(key[(row == 1) & (side == 1)])
        assert set(key[(row == 1) & (side == 0)]) & set(key[(row == 0) & (side == 1)])


def test_simhash_against_all_pairs(spark, nothing):
    dice = random.Random(4)
    rows = [(i, " ".join(prose(dice, dice.choice([0, 1, 2, 3, 40, 200])))) for i in range(60)]
    for i in range(60, 160):
        words = rows[dice.randrange(60)][1].split()
        if words:
            words[dice.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    prints = {i: slow_fingerprint(text) for i, text in rows}
    wanted = slow_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert all(r.fingerprint == simhash.signed(prints[r.doc_id]) for r in found)
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_messy(messy):
    found = {r.doc_id: r for r in simhash.near_duplicates(messy).collect()}
    assert found[3].fingerprint == found[4].fingerprint == found[5].fingerprint == 0
    assert {found[i].component_id for i in (3, 4, 5)} == {3} and found[2].component_id == 1
    assert found[None].component_id == found[9].component_id == 9


def benchmark_and_docs(dice):
    items = [(i, " ".join(prose(dice, dice.randint(16, 50)))) for i in range(8)]
    docs = []
    for i in range(60):
        words = prose(dice, 120)
        if i % 3 == 0:
            inserted = items[dice.randrange(8)][1].split()
            for at in dice.sample(range(len(inserted)), len(inserted) // 8):
                inserted[at] = "swapped"
            words[50:50] = inserted
        docs.append((i, " ".join(words)))
    return docs, items


def test_decontaminate_against_every_alignment(spark):
    dice = random.Random(6)
    docs, items = benchmark_and_docs(dice)
    wanted = set()
    for d, text in docs:
        for i, item in items:
            doc, of = decontaminate.tokens(text), decontaminate.tokens(item)
            for shift in range(-len(of), len(doc)):
                low, high = max(0, shift), min(len(doc), shift + len(of))
                same = doc[low:high] == of[low - shift : high - shift]
                if any(
                    same[a:b].mean() >= 0.8
                    for a in range(len(same))
                    for b in range(a + min(13, len(of)), len(same) + 1)
                ):
                    wanted.add((d, i))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 0):
        found = decontaminate.contaminated(*frames, max_seeds=limit).collect()
        assert {(r.doc_id, r.item_id) for r in found} == wanted and len(found) == len(wanted)
        assert all(r.same_tokens >= 0.8 * r.tokens for r in found)
    assert len(wanted) >= 20


def test_decontaminate_messy(spark, messy, nothing):
    items = spark.createDataFrame(
        [(1, "Quick brown fox, jumps over the lazy dog again and again!"), (2, None), (3, ""), (None, "ü"), (4, "...")],
        "item_id long, text string",
    )
    for limit in (1 << 20, 0):
        found = decontaminate.contaminated(messy, items, max_seeds=limit).collect()
        assert sorted((r.doc_id, r.item_id, r.start) for r in found) == [(1, 1, 1), (2, 1, 1), (2, 1, 1)]
        assert decontaminate.contaminated(nothing, items, max_seeds=limit).count() == 0
        assert decontaminate.contaminated(messy, items.filter("false"), max_seeds=limit).count() == 0


def test_passages(spark, messy, nothing):
    dice = random.Random(8)
    shared = "\n".join(" ".join(prose(dice, n)) for n in (30, 4, 40))
    near = shared.split("\n")[2].split()
    near[-1] = "changed"
    short = " ".join(prose(dice, 12))
    rows = [(i, " ".join(prose(dice, 60)) + "\n" + short) for i in range(30)]
    rows += [(100 + i, " ".join(prose(dice, 60)) + "\n" + shared + "\n\n" + " ".join(prose(dice, 60))) for i in range(10)]
    rows += [(200, "\n".join([*shared.split("\n")[:2], " ".join(near)]))]
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {*range(100, 110), 200}
    assert len(found) == 33 and sum(not r.removed for r in found) == 3
    assert {r.first_doc_id for r in found} == {100}
    text = dict(rows)
    assert {text[r.doc_id][r.start : r.end] for r in found if r.doc_id != 200} == set(shared.split("\n"))
    assert paragraphs.repeated_passages(nothing).count() == 0
    assert {r.doc_id for r in paragraphs.repeated_passages(messy, passage=5).collect()} == {1, 2}


def test_texts_hashed_together_are_hashed_as_alone():
    dice = random.Random(5)
    texts = ["\n".join(" ".join(prose(dice, dice.choice([1, 3, 5, 40]))) for _ in range(dice.randrange(6))) for _ in range(40)]
    texts[3:5] = [None, " \n\t"]
    mixers, line, word = paragraphs._mixers(), 0, 0
    together = paragraphs.Words(*texts)
    marks, least = together.marks(mixers), paragraphs.anchors(together.hashes, 33)
    for text, (line_end, word_end) in zip(texts, together.ends, strict=True):
        alone = paragraphs.Words(text)
        assert together.places[line:line_end] == alone.places and (marks[line:line_end] == alone.marks(mixers)).all()
        assert (together.hashes[word:word_end] == alone.hashes).all()
        if len(alone.words) >= 33:
            assert (least[word : word_end - 32] == paragraphs.anchors(alone.hashes, 33)).all()
        line, word = line_end, word_end
    cut = [(first, len(of.ends)) for first, of in paragraphs.bundles(pa.array(["x" * paragraphs.BUNDLE, "a", None, "y" * paragraphs.BUNDLE, "b"]))]
    assert cut == [(0, 1), (1, 3), (4, 1)]


def test_sketches_never_hide_similar_sets():
    dice = np.random.default_rng(3)
    for size in (1, 5, 60, 900):
        for kept in (0.5, 0.8, 0.9, 1.0):
            one = np.unique(dice.integers(0, 1 << 63, size, np.uint64))
            two = np.unique(np.concatenate([one[: int(kept * len(one))], dice.integers(0, 1 << 63, size // 10, np.uint64)]))
            differ = len(np.setxor1d(one, two))
            bits = np.bitwise_count((paragraphs.sketch(one) ^ paragraphs.sketch(two)).view(np.uint64)).sum()
            assert bits <= differ and (differ - bits) % 2 == 0


@pytest.mark.parametrize(("rounds", "part"), [(2, 2048), (0, 7)])
def test_paragraph_classes_against_all_pairs(spark, monkeypatch, rounds, part):
    monkeypatch.setattr(paragraphs, "ROUNDS", rounds)
    monkeypatch.setattr(paragraphs, "SLICE", part)
    dice = random.Random(11)
    base = prose(dice, 60)
    lines = []
    for _ in range(120):
        words = list(base)
        for at in dice.sample(range(60), dice.choice([1, 1, 2, 3])):
            words[at] = f"new{dice.randint(0, 10**9)}"
        lines.append(" ".join(words))
    for i in range(80):
        words = prose(dice, 50)
        lines += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join([*words, "more", "words"])]
    lines = sorted(set(lines))
    split = [line.encode().split() for line in lines]
    sets = [set(paragraphs.shingles(words)) for words in split]
    wanted = slow_components(range(len(lines)), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").selectExpr("*", "xxhash64(doc_id, text) AS _of")
    table = paragraphs._shared(docs, paragraphs.PASSAGE)
    units = paragraphs.keep(paragraphs._units(docs.withColumn("_row", F.col("doc_id")), table, paragraphs.PASSAGE), "test-units")
    found = {bytes(r.text_id): r.component for r in paragraphs.classes(docs, units.filter("kind < 2")).collect()}
    # Lines that share nothing with another document are left out.
    ours = [found.get(paragraphs.text_id(words), -1 - at) for at, words in enumerate(split)]
    pairs = [(a, b) for a in range(len(lines)) for b in range(a)]
    missed = sum(wanted[a] == wanted[b] and ours[a] != ours[b] for a, b in pairs)
    extra = sum(wanted[a] != wanted[b] and ours[a] == ours[b] for a, b in pairs)
    assert extra == 0 and missed <= 0.02 * sum(wanted[a] == wanted[b] for a, b in pairs)


def test_every_repeated_window_is_listed(spark):
    dice = random.Random(12)
    shared = prose(dice, 70)
    rows = [(i, " ".join(prose(dice, 90))) for i in range(20)]
    for i in range(20, 32):
        # Inside a longer line, across line ends that differ, next to words that repeat too.
        part = shared[dice.randrange(15) : 70 - dice.randrange(6)]
        words = prose(dice, 40) + [w.upper() if dice.random() < 0.1 else w for w in part] + prose(dice, 40)
        rows.append((i, "".join(w + dice.choice([" "] * 30 + ["\n", "  ", "\n\n"]) for w in words)))
    rows += [(50, "filler " * 200), (51, "filler " * 120), (52, rows[0][1] + "\n" + rows[1][1] + " end")]
    words = {i: [(m.group().lower(), *m.span()) for m in paragraphs.WORD.finditer(text)] for i, text in rows}
    seen = {}
    for i, of in words.items():
        for at in range(len(of) - 49):
            seen.setdefault(tuple(w for w, _, _ in of[at : at + 50]), set()).add(i)
    wanted = {i: set() for i in words}
    for i, of in words.items():
        for at in range(len(of) - 49):
            if len(seen[tuple(w for w, _, _ in of[at : at + 50])]) > 1:
                wanted[i].update(range(at, at + 50))
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(map(len, wanted.values())) > 700
    for i, of in words.items():
        spans = sorted((r.start, r.end) for r in found if r.doc_id == i)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        covered = {at for at, (_, start, end) in enumerate(of) if any(a <= start and end <= b for a, b in spans)}
        assert wanted[i] <= covered
    for r in found:
        text = dict(rows)[r.doc_id]
        assert r.words == len(text[r.start : r.end].split())
        assert r.removed == (r.first_doc_id != r.doc_id) or r.doc_id == 50
        lines = list(paragraphs.paragraphs(text))
        assert lines[r.paragraph][0] <= r.start + len(text[r.start :]) - len(text[r.start :].lstrip()) < lines[r.paragraph][1]


def test_altered_copies_inside_longer_lines(spark):
    """Every pair of 120-word passages with two words altered, no line break near them, against recall of 0.9."""
    dice = random.Random(13)
    rows = []
    for pair in range(150):
        edit = ("swap", "drop", "insert")[pair % 3]
        passage = [f"{pair}x{word}" for word in prose(dice, 120)]
        copy = list(passage)
        for at in sorted(dice.sample(range(5, 115), 2), reverse=True):
            copy[at : at + (edit != "insert")] = [] if edit == "drop" else [f"new{dice.randint(0, 10**9)}"]
        for number, part in enumerate((passage, copy)):
            rows.append((2 * pair + number, " ".join(prose(dice, 45) + part + prose(dice, 45))))
    rows += [(1000 + i, " ".join(prose(dice, 200))) for i in range(50)]
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = {}
    for r in found:
        assert r.doc_id < 1000 and r.first_doc_id // 2 == r.doc_id // 2
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
    # Both sides are listed, by most of their words.
    whole = sum(words.get(2 * pair, 0) >= 60 and words.get(2 * pair + 1, 0) >= 60 for pair in range(150))
    assert whole >= 0.9 * 150


def test_every_line_mark_and_span_key_depends_on_the_words_there():
    dice = random.Random(14)
    words = prose(dice, 150)
    one = paragraphs.Words(" ".join(words))
    two = paragraphs.Words("a b c\n" + "\n".join(["x y", " ".join(words), "z"]))
    mixers = paragraphs._mixers()
    assert (one.marks(mixers)[0] == two.marks(mixers)[2]).all()
    assert two.counts.tolist() == [3, 2, 150, 1] and len({*two.marks(mixers)[[0, 1, 3], 0].tolist()}) == 3
    wanted = np.unique(paragraphs.anchors(one.hashes, 33))
    here, there = paragraphs.spans(one.hashes, wanted, 50), paragraphs.spans(two.hashes, wanted, 50)
    assert len(here[0]) > 5 and {*map(tuple, here[2].tolist())} <= {*map(tuple, there[2].tolist())}
    assert all(50 <= n < 75 for n in here[1])


def test_decontaminate_at_the_limit_of_similarity():
    dice = np.random.default_rng(9)
    for size in range(1, 21):
        item = dice.integers(1, 1 << 63, size, np.uint64)
        index = decontaminate.Index([(1, item)])
        for out in itertools.combinations(range(size), size - -(-4 * size // 5)):
            copy = item.copy()
            copy[list(out)] = 0
            doc = np.concatenate([dice.integers(1, 1 << 63, 9, np.uint64), copy, dice.integers(1, 1 << 63, 9, np.uint64)])
            assert decontaminate.best_overlaps(doc, index.hits(doc), index.items), (size, out)


def test_decontaminate_short_items(spark):
    items = spark.createDataFrame([(1, "red fox"), (2, "one two three four five six"), (3, "alone")], "item_id long, text string")
    docs = [(1, "see the red fox run over the far hill today"), (2, "count one two other four five six and so on again"), (3, "alone"), (4, "red hot fox")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (1 << 20, 0):
        found = decontaminate.contaminated(docs, items, max_seeds=limit).collect()
        assert sorted((r.doc_id, r.item_id, r.start, r.tokens) for r in found) == [(1, 1, 2, 2), (2, 2, 1, 6), (3, 3, 0, 1)]
