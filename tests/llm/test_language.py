import random
import zlib

from roadpulse.llm import language as L

from .fixtures import edge_docs, no_docs

EN = "the cat sat on the mat and then the dog came with this other thing that was not there "
FR = "le chat est dans la maison avec une souris qui mange du fromage pour les enfants et nous "


def slow_phrases(training, text):
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in training:
            n += 1
        count += 1
        i += max(1, n - 1)
    return count


def test_phrases_are_longest_matches():
    m = L.Model({"en": [EN * 3], "fr": [FR * 3]})
    for text in (EN[5:60] + FR[:30], "zzz", "a", FR + "qq " + EN):
        coded = m.alphabet.encode(text)
        as_text = "".join(chr(65 + s) for s in coded)
        for j, t in enumerate((EN * 3, FR * 3)):
            training = "".join(chr(65 + s) for s in m.alphabet.encode(t))
            want = slow_phrases(training, as_text)
            got = m.costs([text])[0, j] * len(coded) / m.bits[j]
            assert round(got, 6) == want


def test_edges_and_accuracy(spark):
    rows = [(i, (EN if i % 2 else FR)[i % 7 :] * (1 + i % 3), "en" if i % 2 else "fr", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "123 !!", "fr", "s"), (102, "", None, "s"), (None, EN, None, "s"), (103, EN * 5000, "en", "s"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by[100]["score"] == 0
    assert by[103]["lang_pred"] == by[None]["lang_pred"] == "en"
    assert all(by[r[0]]["lang_pred"] == r[2] for r in rows[:60])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_letters_stay_apart():
    """Languages in which every letter is rarer than the 62 commonest."""
    r = random.Random(5)
    latin = EN + " ".join(map(chr, range(0x430, 0x450))) + " " + " ".join(map(chr, range(0x3B1, 0x3CA)))
    scripts = {"ja": range(0x3041, 0x3097), "ko": range(0xAC00, 0xAC00 + 900), "zh": range(0x4E00, 0x4E00 + 3500), "zz": range(0x20000, 0x20000 + 900)}

    def text(lang, n=300):
        return "".join(chr(r.choice(scripts[lang])) for _ in range(n))

    training = {k: [text(k, 4000)] for k in scripts} | {"en": [latin * 300]}
    m = L.Model(training)
    letters = sorted({c for t in training.values() for c in t[0].lower() if c.isalpha()})
    assert len({bytes(m.alphabet.encode(c)) for c in letters}) == len(letters) > 4096
    assert m.alphabet.size <= 2 + L.LETTERS + L.DIGITS
    # Of a run of letters, the symbols of each, one after the other.
    mixed = "ab" + text("zh", 5) + "c" + text("ja", 3)
    assert bytes(m.alphabet.encode(mixed)) == b"".join(bytes(m.alphabet.encode(c)) for c in mixed)
    names, _ = m.predict([text(k) for k in scripts for _ in range(5)])
    assert names == [k for k in scripts for _ in range(5)]


def test_training_takes_equal_shares_of_different_texts(spark):
    rows = [(i, "copied " * 100, "en") for i in range(400)]  # most rows are copies
    rows += [(1000 + i, f"text number {i} " * 40, "en") for i in range(150)]
    rows += [(2000 + i, f"long {i} " * 20_000, "en") for i in range(3)] + [(3000, "short", "en"), (3001, "short too", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(~L.held_out(L.F.col("doc_id")))
    different = {t for (t,) in docs.filter("lang = 'en'").select("text").distinct().collect()}
    got = L.training_texts(docs, rows=200, chars=20_000)["en"]
    assert len(got) == len(set(got)) == len(different)
    assert sum(map(len, got)) == 20_000
    assert max(map(len, got)) - min(len(t) for t in got if t != "short") <= 1
    assert L.equal_shares(["a" * 9, "b", "c" * 3], 8) == ["a" * 4, "b", "c" * 3]
    assert L.equal_shares([], 8) == [] and L.equal_shares(["ab"], 8) == ["ab"]


def test_nothing_to_learn(spark):
    assert L.identify(no_docs(spark)).count() == 0
    docs, rows = edge_docs(spark)
    got = L.identify(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} == {"und"}
