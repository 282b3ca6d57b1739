import hashlib
import random
import re

from caseloom.llm import disclosure, language, toxicity

SLOW = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def slow_spans(text):
    def valid(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(part) <= 255 for part in found.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return kind != "phone" or 8 <= len(digits) <= 15

    return {kind: [m.span() for m in of.finditer(text) if valid(kind, m.group())] for kind, of in SLOW.items()}


def test_base_spans_against_the_patterns():
    dice = random.Random(1)
    parts = ["a@b.c", "@", "x.y", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+1 (743) 555-3824", ".", "-", " ", "é", "+", "0", "77", "@d.e-f", "\n", "%"]
    for _ in range(4000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 12)))
        assert disclosure.base_spans(text) == slow_spans(text), text


def test_disclosure(spark, messy, nothing):
    dice = random.Random(2)
    rows = []
    for i in range(400):
        words = [f"{chr(97 + dice.randrange(26))}{chr(97 + dice.randrange(26))}" for _ in range(60)]
        if i % 8 == 0:
            words[30:30] = ["dial", f"+1 (743) 555-{dice.randint(1000, 9999)}"]
        rows.append((i, " ".join(words)))
    rows.append((900, "dial nobody"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in disclosure.find(docs).collect()}
    for i, text in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, of in slow_spans(text).items() for a, b in of)
        assert found[i].base == base
        extra = found[i].spans.removeprefix(base).strip(",").split(",")
        at = text.find("dial")
        assert extra == ([f"removed:{at}:{at + 4}"] if i % 8 == 0 and i < 900 else [""])
    assert disclosure.sanitise(rows[0][1], found[0].spans).count("<PHONE>") == 1
    assert disclosure.digest_of(rows[0][1]) == hashlib.sha256(found[0].base.encode()).hexdigest()
    assert disclosure.find(messy).count() == 10 and disclosure.find(nothing).count() == 0


def test_disclosure_of_rare_terms_and_copies(spark):
    dice = random.Random(5)
    pool = [f"{chr(97 + dice.randrange(26))}{chr(97 + dice.randrange(26))}" for _ in range(60)]
    rows = [(i, " ".join(dice.choice(pool) for _ in range(400))) for i in range(200)]
    # A name that occurs once, only near an address; a word that is as frequent elsewhere, in copies.
    rows.append((300, f"{rows[0][1]} zaphod a.b@c.org {rows[1][1]}"))
    rows += [(400 + i, f"{rows[2][1]} harbour a.b@d.org {rows[3][1]}") for i in range(40)]
    rows += [(500 + i, f"{rows[i][1]} harbour {rows[i + 1][1]}") for i in range(10, 30)]
    found = {r.doc_id: r for r in disclosure.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[200][1].index("zaphod")
    listed = found[300].spans.split(",")
    assert f"term:{at}:{at + 6}" in listed or f"removed:{at}:{at + 6}" in listed
    assert len(listed) == 2
    assert all(found[i].spans == found[i].base for i in range(400, 440))


def test_sanitise_overlaps():
    assert disclosure.sanitise("0123456789", "email:2:5,term:4:6,removed:7:9") == "01<EMAIL>569"


def test_language(spark, messy, nothing):
    model = language.train(messy.filter("length(text) < 1000"))
    found = {r.doc_id: r for r in language.predict(messy, model).collect()}
    assert [found[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and found[3].score == 0.0
    assert found[1].lang_pred == "en" and found[9].lang_pred == found[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in found.values()) and found[1]["_count"] == "x"
    assert language.predict(nothing, model).count() == 0
    untaught = language.predict(messy, language.train(nothing)).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}


def test_language_pieces_do_not_change_the_counts(monkeypatch):
    texts = ["abcdefghij" * 7, "", None, "xyz", "ä" * 25]

    def counted():
        grams = [language.grams(*piece) for piece in language.pieces(texts)]
        return sorted((int(n), int(b)) for of in grams for number, bucket in of for n, b in zip(number, bucket))

    whole = counted()
    monkeypatch.setattr(language, "CHUNK", 10)
    assert counted() == whole


def test_toxicity(spark, messy, nothing):
    dice = random.Random(3)
    rows = [(i, " ".join(dice.choice(["red", "blue", "green", "sun", "moon"]) for _ in range(20)), i % 3 == 0) for i in range(150)]
    rows = [(i, text + (" you awful group" if bad else ""), int(bad)) for i, text, bad in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, bad) for i, _, bad in rows] + [(None, 1), (7, None)], "doc_id long, label int")
    model = toxicity.fit(toxicity.sample(docs, labels))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((scores[i] >= 0.7) == bool(bad) for i, _, bad in rows)
    found = toxicity.score(messy, model).collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(toxicity.sample(docs, labels.filter("label = 0")))
    assert {r.score for r in toxicity.score(messy, none).collect()} == {0.0}
