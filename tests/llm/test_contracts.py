"""Queries with a fixed result, against brute force, on odd documents and on the small table."""

import hashlib
import itertools
import math
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from readsieve.llm import langid, lbl_lm, packing, phrases, pii, simhash, tiff
from readsieve.storage import Workspace

from ..oracles import assert_same
from .data import frame, lower, odd_documents, small, words


def inputs(spark):
    odd = odd_documents()
    rest = [(1000 + d, t, lang, s, n) for d, t, lang, s, n in small(columns="doc_id, text, lang, source, n_chars")]
    return odd + rest, frame(spark, odd + rest)


@pytest.fixture(scope="module")
def documents(spark):
    rows, df = inputs(spark)
    return rows, df.repartition(5).cache()


def same(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_empty_table(spark):
    df = frame(spark, [])
    assert pii.report(df).count() == simhash.near_duplicates(df).count() == phrases.report(df).count() == 0
    assert lbl_lm.score_texts(df).count() == langid.identify(df).count() == tiff.text_media(df).count() == 0
    assert packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (rule, fits) in enumerate(rules) for m in re.finditer(rule, text or "") if fits(m[0]))


def test_pii(spark, documents):
    rng = np.random.default_rng(3)
    noise = [(5000 + i, "".join(rng.choice(list("ab1 2@.+-()9\x01\x02_%é💥0"), int(rng.integers(0, 90)))), None, None, None) for i in range(300)]
    cases = ["call +49 30 1234567 now", "4111 1111 1111 1111, 4111-1111-1111-1112", "x@y.z+q@r.st", "1.2.3.256 1.2.3.255 001.02.3.4.5", "1" * 4000 + " " + "a" * 9000 + "@" + "a." * 4000, "(ñ) ip 10.0.0.1"]
    rows = documents[0] + noise + [(6000 + i, t, None, None, None) for i, t in enumerate(cases)]
    expected = []
    for doc, text, *_ in rows:
        spans = base_spans(text)
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        expected.append((doc, *(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(said.encode()).hexdigest()))
    out = pii.report(frame(spark, rows)).collect()
    same([tuple(r)[:6] for r in out], expected)
    for r in out:  # base spans are among all spans
        assert Counter(s.split(":")[0] for s in r["spans"].split(",") if s)["ip"] == r["n_ip"]


def test_pii_sql(spark):
    rng = np.random.default_rng(9)
    letters = list("ab1 2@.+-()9_%éIDE8") + [" call ", " iban ", "DE89370400440532013000", "212-555-0199", "GB82 WEST 1234 5698 7654 32", " ip ", "4111 1111 1111 1111", "+1 212-555-0199", "10.0.0.1"]
    rows = [(i, "".join(rng.choice(letters, int(rng.integers(0, 40)))), None, None, None) for i in range(400)] + [(900, None, None, None, None), (901, "", None, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert assert_same(pii.report(frame(spark, rows)), pii.ORACLE_SQL, con) == len(rows)
    kinds = Counter(x.split(":")[0] for r in con.sql(pii.ORACLE_SQL).fetchall() for x in r[6].split(",") if x)
    assert set(kinds) == set(pii.KINDS)


def test_pii_added_kinds_and_redaction(spark):
    text = "order 212-555-0198; bank: DE89 3704 0044 0532 0130 00; DE88 3704 0044 0532 0130 00; call 212-555-0199; at x@y.zz"
    df = frame(spark, [(1, text, None, None, 3), (2, None, None, None, None), (3, "clean", None, None, 5)])
    out = pii.report(df).where("doc_id = 1").first()
    at = text.index("DE89"), text.index("212-555-0199")
    assert out["spans"] == f"iban:{at[0]}:{at[0] + 27},local_phone:{at[1]}:{at[1] + 12},email:{len(text) - 6}:{len(text)}"
    assert float(out["scores"].split(",")[0]) > pii.SCORES["iban"]
    cleaned = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert cleaned[1]["text"] == text.replace("DE89 3704 0044 0532 0130 00", "[IBAN]").replace("call 212-555-0199", "call [LOCAL_PHONE]").replace("x@y.zz", "[EMAIL]")
    assert cleaned[2]["text"] is None and cleaned[3]["text"] == "clean"
    assert pii.redact(df).columns == df.columns


def test_pii_in_texts_with_very_many_spans(spark):
    """100,000 addresses, and IBANs between them: a fold that copied what it has found would take hours."""
    iban = "DE89 3704 0044 0532 0130 00"
    text = " ".join(f"u{i}@x.org, {iban};" if i % 10_000 == 0 else f"é{i}: u{i}@x.org" for i in range(100_000))
    df = frame(spark, [(1, text, None, None, 3)])
    out = pii.report(df).first()
    spans = [s.split(":") for s in out["spans"].split(",")]
    assert out["n_email"] == 100_000 and sum(k == "iban" for k, *_ in spans) == 10
    emails = [f"email:{m.start()}:{m.end()}" for m in re.finditer("u[0-9]+@x.org", text)]
    assert out["base_sha256"] == hashlib.sha256(",".join(emails).encode()).hexdigest()
    assert all(text[int(a) : int(b)] == iban for k, a, b in spans if k == "iban")
    assert pii.redact(df).first()["text"] == re.sub("u[0-9]+@x.org", "[EMAIL]", text).replace(iban, "[IBAN]")


def test_pii_context_after_a_span(spark):
    df = frame(spark, [(1, "212-555-0199 is my phone", None, None, 3), (2, "212-555-0199 is a number", None, None, 3), (3, "212-555-0199 " + "x" * 40 + " phone", None, None, 3)])
    assert {r["doc_id"]: r["spans"] for r in pii.report(df).collect()} == {1: "local_phone:0:12", 2: "", 3: ""}


def test_pii_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a@b.cc", "x", "y", "z")], "doc_id long, text string, _pii_spans string, _pii_clean string, `a.b` string")
    assert tuple(pii.redact(df).first()) == (1, "[EMAIL]", "x", "y", "z") and pii.redact(df).columns == df.columns
    assert tuple(pii.find(df).first())[:5] == (1, "a@b.cc", "x", "y", "z")


def test_iban_among_upper_case_words_and_numbers(spark):
    gb, de, no = "GB29NWBK60161331926819", "DE89 3704 0044 0532 0130 00", "NO9386011117947"
    cases = [
        (f"{gb} BIC: X", [gb]), (f"{de} BIC COBADEFF", [de]), ("DE89370400440532013000 EUR 500", ["DE89370400440532013000"]),
        ("é GB29 NWBK 6016 1331 9268 19 I will", ["GB29 NWBK 6016 1331 9268 19"]), (f"{no} {no}", [no, no]), (f"ID99 ABC {de} 7", [de]),
        (f"x{gb} {gb}x", []), ("GB29NWBK60161331926818 BIC", []),
    ]
    df = frame(spark, [(i, text, None, None, None) for i, (text, _) in enumerate(cases)])
    spans = {r["doc_id"]: [s["match"] for s in r["pii"] if s["kind"] == pii.KINDS.index("iban")] for r in pii.find(df.drop("pii")).collect()}
    places = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["pii"] if s["kind"] == pii.KINDS.index("iban")] for r in pii.find(df.drop("pii")).collect()}
    assert spans == places == {i: expected for i, (_, expected) in enumerate(cases)}
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[1] == "[IBAN] BIC COBADEFF"


def test_lm_base(documents):
    rows, df = documents
    tokens = lambda text: words(lower(text or "")) + [None]
    fold = lambda doc: 2 if doc is None else zlib.crc32(str(doc).encode()) % 7
    count = Counter(t for doc, text, *_ in rows if fold(doc) != 2 for t in tokens(text))
    n, v = sum(count.values()), len(count)
    expected = []
    for doc, text, *_ in rows:
        own = tokens(text)
        expected.append((doc, fold(doc) == 2, len(own), sum(count[t] > 0 for t in own), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own), 5)))
    out = lbl_lm.score_texts(df).collect()
    same([(*tuple(r)[:5], round(r["base_score"], 5)) for r in out], expected)
    held = [r for r in out if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in out)


def test_lm_is_normalised(monkeypatch):
    table = lbl_lm.train(np.random.default_rng(0).integers(0, 9, (lbl_lm.CLASSES, lbl_lm.CLASSES)).astype(float))
    assert np.allclose((10.0 ** table.astype(np.float64)).sum(axis=1), 1, atol=1e-4)
    monkeypatch.setattr(lbl_lm, "OWN_CLASSES", 2)
    head = [(b"aa", 9), (b"bb", 5), (b"cc", 3), (b"dd", 2), (lbl_lm.END, 4)]
    by_suffix = {}
    for w, n in head[:4] + [(b"xcc", 1)]:
        k = zlib.crc32(w[-2:]) % lbl_lm.SUFFIX_CLASSES
        by_suffix[k] = tuple(np.add(by_suffix.get(k, (0, 0)), (n, 1)))
    voc = lbl_lm.Vocabulary(head, 24, 6, by_suffix)
    shared = 3 + zlib.crc32(b"cc") % lbl_lm.SUFFIX_CLASSES
    assert 10 ** voc.class_total[shared] == pytest.approx((3 + 1) + 2 + 1)  # cc and xcc, and one unseen word


def test_lm_rare_words_have_contexts_of_their_own(spark, monkeypatch):
    """Words of one shared class are told apart by what stands before and after each."""
    filler = [f"f{i}x{i % 7}" for i in range(lbl_lm.OWN_CLASSES + 13)]
    said = ["kiwi qqab lime", "plum wwab pear"]
    rows = [(i, " ".join(filler) + " kiwi plum lime pear" * 3) for i in range(40)] + [(100 + i, said[i % 2]) for i in range(30)]
    held = itertools.islice((i for i in itertools.count(1000) if zlib.crc32(str(i).encode()) % 7 == 2), 4)
    tests = dict(zip(held, ["kiwi qqab lime", "plum wwab pear", "kiwi wwab lime", "plum qqab pear"]))
    df = frame(spark, [(*r, None, None, None) for r in [*rows, *tests.items()]])
    found = []
    for head in (lbl_lm.HEAD_WORDS, lbl_lm.OWN_CLASSES + 19):  # by the broadcast, and by the gathered occurrences
        monkeypatch.setattr(lbl_lm, "HEAD_WORDS", head)
        score = {tests[r["doc_id"]]: r["score"] for r in lbl_lm.score_texts(df).where("doc_id >= 1000").collect()}
        seen, unseen = (sum(score[t] for t in part) for part in (said, ["kiwi wwab lime", "plum qqab pear"]))
        assert seen > unseen + 0.1
        found.append([score[t] for t in tests.values()])
    assert np.allclose(*found, atol=1e-3)


def test_lm_own_embeddings_are_normalised():
    rng = np.random.default_rng(1)
    model = lbl_lm.Model(*rng.integers(0, 9, (3, lbl_lm.CLASSES, lbl_lm.CLASSES)).astype(float))
    n = np.array([1, 3, 40])
    starts, near = np.array([0, 1, 4]), rng.integers(0, lbl_lm.CLASSES, 44)
    kind = np.array([lbl_lm.CLASSES - 1, lbl_lm.CLASSES - 1, lbl_lm.CLASSES - 2])
    own, log_z = model.inputs(kind, starts, near, np.ones(44))
    for groups in range(lbl_lm.GROUPS**2):
        p = model.after.reference[kind] * np.exp(own @ model.after.features.T + model.shift[groups] - log_z[:, [groups]])
        assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and np.abs(own).max() > 0
    out = model.before.fit(kind, starts, near, np.ones(44))
    z = np.zeros((lbl_lm.SUFFIX_CLASSES, lbl_lm.CLASSES))
    model.add_outputs(z, out, kind, n)
    expected = (n[:2, None] + 1) * np.exp(out[:2].astype(float) @ model.before.features.T)
    assert np.allclose(z[-1], expected.sum(axis=0)) and z[-2].min() > 0 and not z[:-2].any()


def test_lm_places_far_back_count(spark):
    """What follows a filler word is told by the word two, or three, places back only."""
    rows = []
    for i in range(120):
        a, b = ("red", "wine") if i % 2 else ("blue", "sea")
        rows += [(3 * i, " ".join([a, "and", b] * 10)), (3 * i + 1, " ".join([a, "so", "so", b] * 10)), (3 * i + 2, f"w{i}")]
    held = list(itertools.islice((i for i in itertools.count(10_000) if zlib.crc32(str(i).encode()) % 7 == 2), 4))
    said = ["red and wine", "red and sea", "blue so so sea", "blue so so wine"]
    out = lbl_lm.score_texts(frame(spark, [(*r, None, None, None) for r in [*rows, *zip(held, said)]])).where("doc_id >= 10000").collect()
    score = {said[held.index(r["doc_id"])]: r["score"] for r in out}
    assert score["red and wine"] > score["red and sea"] + 0.3 and score["blue so so sea"] > score["blue so so wine"] + 0.3


def test_lm_frequent_words_beyond_the_head(spark, monkeypatch):
    """Fitted from sums, they score as from their gathered occurrences; some never occur in what is learned."""
    rng = np.random.default_rng(6)
    vocabulary = [f"v{i}x{i % 9}" + "-" * (150 if i % 50 == 9 else 0) for i in range(700)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)), p=(p := 1 / np.arange(30, 730)) / p.sum())) for _ in range(400)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "only here " * 40 + texts[0], None, None, None)] * 2
    df = frame(spark, rows)
    monkeypatch.setattr(lbl_lm, "HEAD_WORDS", lbl_lm.OWN_CLASSES + 60)
    found = []
    for gathered in (20_000, 6):
        monkeypatch.setattr(lbl_lm, "GATHERED", gathered)
        work = Workspace(spark, "test")
        _, often = lbl_lm._learn(df.where("crc32(cast(doc_id as string)) % 7 <> 2").select("text"), work)
        assert (often.count() >= 30) == (gathered < 20_000)
        widest = lbl_lm._beside(spark.createDataFrame([("w", i % 9) for i in range(5000)], "word string, around int"), spark.createDataFrame([("w",)], "word string"))
        assert len(widest.first()["near"]) == 10  # one entry for each class and side, however many occurrences
        found.append(sorted((r["doc_id"] is None, r["doc_id"], r["n_known"], r["base_score"], r["score"]) for r in lbl_lm.score_texts(df).collect()))
    for other in found[1:]:
        assert [r[:3] for r in found[0]] == [r[:3] for r in other]
        assert np.allclose([r[3:] for r in found[0]], [r[3:] for r in other], rtol=1e-5, atol=1e-3)


def test_lm_long_words(spark):
    """A long word is known as any other, in the head if it is frequent, and by its last bytes' class."""
    line, other = b"-" * 120, b"-" * 119 + b"="
    assert lbl_lm.stand_in(line) != lbl_lm.stand_in(b"-" * 121) and lbl_lm.stand_in(b"-" * 100) == b"-" * 100
    assert all(lbl_lm.suffix_class(w) == lbl_lm.suffix_class(lbl_lm.stand_in(w)) for w in (line, other))
    df = frame(spark, [(i, f"a {line.decode()} b {line.decode() if i % 2 else other.decode()}", None, None, None) for i in range(200)])
    voc = lbl_lm.learn(df.select("text"), Workspace(spark, "test")).vocabulary
    assert dict(zip(voc.words, voc.counts)) == {b"a": 200, b"b": 200, lbl_lm.stand_in(line): 300, lbl_lm.stand_in(other): 100}
    x = next(voc.encode([line + b" " + other + b" " + b"?" * 200]))
    assert x.at[:2].tolist() == [voc.words[lbl_lm.stand_in(w)] for w in (line, other)] and x.rest == [lbl_lm.stand_in(b"?" * 200)]
    assert {r["n_known"] for r in lbl_lm.score_texts(df).collect()} == {5}


def test_lm_words_are_split_together():
    """Words, positions, classes and counts are those of a loop over the words; no text runs into the next, and no table is built for each of them."""
    texts = [None, b"", b" \n", b"A\x0bB\x1cC \x85\xa0x" + "ÄöÉ z\x1f".encode(), b"-" * 200 + b" q", b"x" * 101, b"x", b"\t a b a ", b"one b"] * 3
    split = [t.lower().split() if t else [] for t in texts]
    words, n = lbl_lm.split_words(texts)
    assert words.to_pylist() == list(itertools.chain(*split)) and n.tolist() == list(map(len, split))
    assert lbl_lm.suffixes(words[2:]).tolist() == [zlib.crc32(w[-2:]) % lbl_lm.SUFFIX_CLASSES for w in words[2:].to_pylist()]
    voc = lbl_lm.Vocabulary([(b"a", 9), (b"b", 5), (lbl_lm.stand_in(b"-" * 200), 3), (lbl_lm.END, 4)], 21, 4, {})
    for x in voc.encode(texts):
        expected = [voc.words.get(lbl_lm.stand_in(w), -1) for own in split for w in [*own, lbl_lm.END]]
        assert x.at.tolist() == expected and x.sizes.tolist() == [len(own) + 1 for own in split]
        assert x.rest == [lbl_lm.stand_in(w) for own in split for w in own if lbl_lm.stand_in(w) not in voc.words]
        assert x.kind[x.missing].tolist() == [lbl_lm.suffix_class(w) for w in x.rest] and not x.kind[x.ends].any()
    batch = pa.RecordBatch.from_arrays([pa.array([None if t is None else t.decode("latin-1") for t in texts[:3] + texts[7:9]])], names=["text"])
    (counted,) = lbl_lm._count_words(iter([batch]))
    assert dict(zip(counted.column("word").to_pylist(), counted.column("n").to_pylist())) == {b"a": 2, b"b": 2, b"one": 1, lbl_lm.END: 5}


def test_lm_neighbours_are_added_up_in_little_memory():
    rng = np.random.default_rng(3)
    known, times, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), Counter()
    for k in range(6):
        fresh = [rng.integers(0, 900, n) for n in (0, 50 * k, 7)]
        seen.update(np.concatenate(fresh).tolist())
        known, times = lbl_lm._with_more(known, times, fresh)
        assert dict(zip(known.tolist(), times.tolist())) == seen and (np.diff(known) > 0).all() and times.dtype == np.int64
    assert [x.tolist() for x in lbl_lm._with_more(known, times, [])] == [known.tolist(), times.tolist()]
    # a task that holds as many neighbours as it may, half of them known: what it takes to add the others
    held = lbl_lm.NEIGHBOURS_TOGETHER
    known, times, fresh = np.arange(0, held, 2), np.ones(held // 2, np.int64), [np.arange(i, held, 20) for i in range(0, 20, 2)]
    tracemalloc.start()
    lbl_lm._with_more(known, times, fresh)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_lm_equals_slow_evaluation(spark):
    """Scores are the probabilities of the definition, summed word by word, and those of all words add up to 1."""
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}x{i % 9}" for i in range(600)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)), p=(p := 1 / np.arange(1, 601)) / p.sum())) for _ in range(300)]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    learned = df.where("crc32(cast(doc_id as string)) % 7 <> 2").select("text")
    voc, m, o = lbl_lm.learn(learned, Workspace(spark, "test"))
    assert len(voc.words) > lbl_lm.OWN_CLASSES + 50
    kind = lambda w: 0 if w is None else int(voc.classes[voc.words[w]]) if w in voc.words else lbl_lm.suffix_class(w)

    def p_class(context):
        """Of all classes, after the last three tokens."""
        h, j = context[-1], kind(context[-1])
        logit = m.log_p[j].astype(float) * math.log(10)
        for place in (0, 1):
            logit = logit + m.far[place][m.group[place][kind(context[-2 - place])]]
        if h in voc.words:
            logit = logit + m.after.features @ o.inputs[voc.words[h]]
        e = np.exp(logit - logit.max())
        return e / e.sum()

    def p_words(context):
        """Of all known words, the end, and one unseen word of each shared class."""
        classes, j = p_class(context), kind(context[-1])
        out, total = {None: classes[0]}, np.ones(lbl_lm.CLASSES)
        weight = {w: (voc.counts[i] + 1) * math.exp(m.before.features[j] @ o.outputs[i]) for w, i in voc.words.items()}
        for w, x in weight.items():
            total[kind(w)] += x if voc.words[w] >= lbl_lm.OWN_CLASSES else 0
        for w, x in weight.items():
            out[w] = classes[kind(w)] * (x / total[kind(w)] if voc.words[w] >= lbl_lm.OWN_CLASSES else 1)
        unseen = {k: classes[k] / total[k] for k in range(1 + lbl_lm.OWN_CLASSES, lbl_lm.CLASSES)}
        return out, unseen

    scores = {r["doc_id"]: r["score"] for r in lbl_lm.score_texts(df).collect()}
    for doc in (0, 7, 8, 50, 123):
        context, expected = [None] * 3, 0.0
        for w in [t.encode() for t in texts[doc].split()] + [None]:
            known, unseen = p_words(context)
            empty = sum(p_class(context)[1 + i] for i in range(len(voc.words), lbl_lm.OWN_CLASSES))
            assert abs(sum(known.values()) + sum(unseen.values()) + empty - 1) < 1e-3
            expected += math.log10(known[w] if w in known else unseen[kind(w)])
            context = [*context[1:], w]
        assert scores[doc] == pytest.approx(expected, abs=1e-3)


def test_keep_known_without_labels(spark):
    rows = [(d, t, None, s, n) for d, t, _, s, n in odd_documents()]
    df = frame(spark, rows)
    kept = langid.keep_known(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert langid.least_known(4) == pytest.approx(langid.LEAST_SCORE)
    assert langid.least_known(1) == pytest.approx(1) and 0.5 < langid.least_known(2) < 1 and langid.least_known(1000) < 0.25


def test_packing(documents):
    rows, df = documents
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    expected = []
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, part in enumerate(itertools.batched(ids, 4096)):
            expected.append((doc, k, 4096 * k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    out = packing.pack(df, path, with_ids=True).collect()
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out], expected)
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in out)
    check_layout([(r["sequence_id"], r["offset"], r["length"]) for r in out], 4096)


def check_layout(pieces, capacity):
    ends = {}
    for sequence, offset, length in sorted(pieces):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert max(ends.values()) <= capacity
    total = sum(length for *_, length in pieces)
    assert len(ends) <= max(-(-total // capacity) * 11 / 9 + 1, 1)


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [101, 12, 60, 100][seed], 500).tolist() + [100] * 3
    histogram = Counter(lengths)
    pieces = []
    for run in packing.plan(dict(histogram), 100):
        pieces += [(run.sequence + k // run.per_sequence, run.offset + k % run.per_sequence * run.length, run.length) for k in range(run.last - run.first)]
    assert Counter(length for *_, length in pieces) == histogram
    check_layout(pieces, 100)
    ranks = {}
    for run in packing.plan(dict(histogram), 100):
        assert run.first == ranks.get(run.length, 0)
        ranks[run.length] = run.last


def test_word_ids_equal_the_tokenizer():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = packing.WordIds(f.read())
    assert encoder.plain
    texts = [t for _, t, *_ in odd_documents() if t] + ["<|endoftext|>x it's ΣΑΣ İ ﬁ é İstanbul STRASSE, don't 123abc ñandú. x.y!? ª", "a\x0bb　c\x85d"]
    expected = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(encoder.encode([t.encode() for t in texts])) == expected


def test_packing_repeated_rows(spark):
    """A document that is repeated very often is ranked by many tasks."""
    cut = spark.range(100_000).selectExpr("cast(null as long) doc_id", "0 piece", "0L start", "1L length", "0L ids_crc32", "id row")
    ranks = packing.ranked(cut, 50).selectExpr("count(distinct rank) n", "min(rank) a", "max(rank) b").first()
    assert tuple(ranks) == (100_000, 0, 99_999)
    out = packing.place(cut)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.select("sequence_id", "offset").distinct().count() == 100_000 and out.agg({"sequence_id": "max"}).first()[0] == -(-100_000 // 4096) - 1


def test_word_ids_of_another_kind_of_vocabulary():
    """Without word ends, or if the quick way gives other ids, the whole tokenizer is asked."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = f.read()
    texts = ["The end, of étés.", "x"]
    slow = packing.WordIds(content)
    slow.plain = False
    assert list(packing.WordIds(content).encode([t.encode() for t in texts])) == list(slow.encode([t.encode() for t in texts]))
    upper = packing.WordIds(content.replace('{"type": "Lowercase"}', '{"type": "Strip", "strip_left": true, "strip_right": true}').replace('{"type":"Lowercase"}', '{"type":"Strip","strip_left":true,"strip_right":true}'))
    assert not upper.plain
    assert list(upper.encode([b"The"])) == upper._full(["The"])


def test_phrases(documents):
    rows, df = documents
    first = {}
    for doc, text, *_ in rows:
        own = words(text)
        for i in range(len(own) - 12) if doc is not None else ():
            key = tuple(own[i : i + 13])
            first[key] = min(first.get(key, doc), doc)
    expected = []
    for doc, text, *_ in rows:
        own = words(text)
        gone = set()
        for i in range(len(own) - 12) if doc is not None else ():
            if first[tuple(own[i : i + 13])] < doc:
                gone |= set(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        expected.append((doc, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    same(map(tuple, phrases.report(df).collect()), expected)


def test_phrase_automaton_compares_words():
    a = phrases.Automaton()
    text = [f"w{i}".encode() for i in range(40)]
    a.add(1, text)
    a.add(7, text[:20])
    a.compile()
    other = [b"x", *text[3:30], b"y", *text[:12], b"z"]
    assert phrases.covered(len(other), a.starts(5, other)).tolist() == [False] + [True] * 27 + [False] * 14
    assert not a.starts(1, other)


def test_language(spark, documents):
    rows, df = documents
    rows = [r for r in rows if r[0] is None or r[0] >= 1000 or r[0] in (4, 5, 6, 200)]
    df = frame(spark, rows)
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    lang, text = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    held = [r for r in out if r["doc_id"] is not None and r["held_out"] and lang[r["doc_id"]] and any(c.isalpha() for c in text[r["doc_id"]] or "")]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (4, 5, 6))
    assert all(0 <= r["score"] <= 1 for r in out)
    kept = langid.keep_known(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} >= {r["doc_id"] for r in held}


def slow_language(rows):
    """The same model by dictionaries: n-grams one by one, a step of FTRL for each row, the temperature from a grid."""
    mask = (1 << 32) - 1

    def counts(text):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        if not letters.strip():
            return None
        padded = " " + " ".join(letters.split()) + " "
        found = Counter()
        for order in langid.ORDERS:
            for i in range(len(padded) - order + 1):
                h = langid._SALTS[order]
                for c, factor in zip(padded[i : i + order], langid._FACTORS.tolist()):
                    h = (h ^ ord(c)) * factor & mask
                    h ^= h >> 15
                found[h % langid.FEATURES] += 1
        return found

    learned = [(lang, c) for doc, text, lang, *_ in rows if doc is not None and lang and zlib.crc32(str(doc).encode()) % 5 and (c := counts(text))]
    met = Counter(k for _, c in learned for k in c)
    idf = lambda k: math.log((1 + len(learned)) / (1 + met[k])) + 1

    def row(c):
        x = {k: math.log1p(n) * idf(k) for k, n in c.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {k: v / length for k, v in x.items()}

    packed = lambda c: (np.array(sorted(c), np.uint16).tobytes(), np.array([c[k] for k in sorted(c)], np.uint32).tobytes())
    learned.sort(key=lambda x: (x[0], *packed(x[1])))
    learned = [learned[i] for i in np.random.default_rng(0).permutation(len(learned))]
    labels = sorted({lang for lang, _ in learned})
    train = [x for i, x in enumerate(learned) if i % 5]
    z, n = {}, {}

    def weight(key):
        a, b = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(a) <= langid.L1 else -math.copysign(abs(a) - langid.L1, a) / ((langid.BETA + math.sqrt(b)) / langid.ALPHA + langid.L2)

    def softmax(s, t=1.0):
        e = [math.exp((x - max(s)) / t) for x in s]
        return [x / sum(e) for x in e]

    score = lambda x: [sum(v * weight((k, j)) for k, v in x.items()) for j in range(len(labels))]
    for epoch in range(langid.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(train)):
            x = row(train[i][1])
            for j, p in enumerate(softmax(score(x))):
                for k, v in x.items():
                    g = v * (p - (labels[j] == train[i][0]))
                    before, w = n.get((k, j), 0.0), weight((k, j))
                    z[k, j] = z.get((k, j), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / langid.ALPHA * w
                    n[k, j] = before + g * g
    rest = [(labels.index(lang), score(row(c))) for i, (lang, c) in enumerate(learned) if not i % 5]
    loss = lambda t: -sum(math.log(max(1e-12, softmax(s, t)[truth])) for truth, s in rest)
    temperature = min((math.exp(x / 50) for x in range(-150, 151)), key=loss)
    out = {}
    for doc, text, *_ in rows:
        p = softmax(score(row(c)), temperature) if (c := counts(text)) else [0.0]
        out[doc] = (labels[p.index(max(p))] if c else "und", max(p))
    return out


def test_language_equals_slow_version(spark):
    rows = [(d, t if d % 9 else None, lang, s, n) for d, t, lang, s, n in small(columns="doc_id, left(text, 150), lang, source, n_chars")]
    expected = slow_language(rows)
    for r in langid.identify(frame(spark, rows)).collect():
        assert r["lang_pred"] == expected[r["doc_id"]][0] and r["score"] == pytest.approx(expected[r["doc_id"]][1], abs=0.02)


def test_language_without_labels(spark):
    df = frame(spark, [(1, "abc", None, None, 3), (2, None, "en", None, None)])
    assert {tuple(r)[2:] for r in langid.identify(df).collect()} == {("und", 0.0)}


def slow_fingerprint(text):
    own = words(lower(text or ""))
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    return {p: root(p) for p in prints}


def test_simhash(documents):
    rows, df = documents
    prints = [(doc, slow_fingerprint(text)) for doc, text, *_ in rows]
    component = slow_components({p for _, p in prints})
    least = {}
    for doc, p in prints:
        if doc is not None:
            least[component[p]] = min(doc, least.get(component[p], doc))
    expected = [(doc, f"{p:016x}", least[component[p]]) for doc, p in prints]
    same(map(tuple, simhash.near_duplicates(df).collect()), expected)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = "_fp _row _file _FILE2 _lang_pred _lang_score _pii_spans a.b n".split()
    rows = [(d, t, "en" if d and d % 2 else "de", *(f"{c}{i}" for c in names)) for i, (d, t, *_) in enumerate(odd_documents())]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", *names])
    df.write.parquet(str(tmp_path / "t"))
    for table in (df, spark.read.parquet(str(tmp_path / "t"))):
        for stage in (simhash.keep_one, langid.keep_known):
            kept = stage(table)
            assert kept.columns == df.columns and set(map(tuple, kept.collect())) < set(rows)
        least = {r["component_id"] for r in simhash.near_duplicates(table).collect()}
        assert sorted(r["doc_id"] for r in simhash.keep_one(table).collect()) == sorted(least)


def test_language_with_very_many_labels(spark):
    rows = [(i, f"{'abc abd' if i % 2 else 'xyz xyw'} q{i}", ("one" if i % 2 else "two") if i % 3 else f"noise{i}", None, 3) for i in range(4000)]
    out = langid.identify(frame(spark, rows)).collect()
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in out if r["held_out"] and lang[r["doc_id"]] in ("one", "two")]
    assert len(out) == len(rows) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.9 * len(held)


@pytest.mark.parametrize("block", [4096, 40])
def test_dense_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(1)
    dense = {0xF0F0F0F0F0F0F0F0 ^ sum(1 << int(b) for b in rng.integers(0, 64, k % 4)) for k in range(300)}
    prints = sorted(dense | {int(x) for x in rng.integers(0, 1 << 63, 100, dtype=np.uint64)} | {0, 7, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    work = simhash.Workspace(spark, "test")
    links = simhash.link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"), work)
    found = {p: p for p in signed}
    found |= {r["node"]: r["component"] for r in simhash.connected_components(links, work).collect()}
    group = lambda labels: sorted(sorted(k for k in labels if labels[k] == c) for c in set(labels.values()))
    truth = slow_components(set(prints))
    assert group({p - (1 << 64) if p >> 63 else p: c for p, c in truth.items()}) == group(found)
    assert links.count() < 40 * len(prints)


def test_hot_key_is_extended(spark):
    """100,000 fingerprints that share a key: they are filed under three keys each, and not compared in pairs of blocks."""
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(0, 1 << 32, 100_000, dtype=np.uint64)) << np.uint64(32)  # the first four bytes are equal
    near = prints[:50] ^ np.uint64(1 << 63 | 1 << 40)
    df = spark.createDataFrame([(int(x),) for x in np.concatenate([prints, near]).view(np.int64)], "fp long").distinct()
    work = simhash.Workspace(spark, "test")
    links = {frozenset((r["u"], r["v"])) for r in simhash.link_fingerprints(df, work).collect()}
    assert {frozenset((int(a), int(b))) for a, b in zip(prints[:50].view(np.int64), near.view(np.int64))} <= links
    assert all((((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3) for a, b in map(tuple, links))


def test_filed_rows_are_not_broadcast(spark, monkeypatch):
    """Each fingerprint becomes 24 rows and more, and the planner takes their table for as small as that of the fingerprints."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    work, plans, save = simhash.Workspace(spark, "test"), [], simhash.Workspace.save
    prints = work.save(spark.createDataFrame([(x << 32,) for x in range(1, 300)], "fp long"))

    def watched(self, df, *codec):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, *codec)

    monkeypatch.setattr(simhash.Workspace, "save", watched)
    simhash.link_fingerprints(prints, work)
    assert len(plans) == 2 and all("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for plan in plans)


def test_chain_filter_is_complete():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        xor = np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, 3)))], dtype=np.uint64)
        assert any(simhash.chain_keeps(xor, np.array([s]))[0] for s in range(8))
        by_segment = [int(xor[0] >> np.uint64(8 * s) & np.uint64(255)) for s in range(8)]
        assert any(simhash.chain_keeps(xor, np.array([s]))[0] and by_segment[s] == by_segment[(s + 1) % 8] == 0 for s in range(8))


def test_text_media(documents):
    rows, df = documents
    expected = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        full = data + bytes(-len(data) % 64 or (0 if data else 64))
        media = tiff.write([full])
        page = next(tiff.read(media))
        assert page.pixels == full
        expected.append((doc, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(media), hashlib.sha256(media).hexdigest(), tiff.features(page)))
    same([tuple(r)[:8] for r in tiff.text_media(df).collect()], expected)


def slow_pixels(media):
    """One page of one or more deflated strips with horizontal differencing, read tag by tag."""
    assert media[:4] == b"II*\0"
    at = int.from_bytes(media[4:8], "little")
    tags = {}
    for i in range(int.from_bytes(media[at : at + 2], "little")):
        tag, kind, count, value = struct.unpack_from("<HHII", media, at + 2 + 12 * i)
        assert kind == 4
        tags[tag] = [value] if count == 1 else list(struct.unpack_from(f"<{count}I", media, value))
    data = b"".join(zlib.decompress(media[o : o + n]) for o, n in zip(tags[273], tags[279]))
    (width,), (height,) = tags[256], tags[257]
    assert len(data) == width * height and tags[259] == [8] and tags[317] == [2] and tags[258] == [8]
    out = bytearray(data)
    for i in range(len(out)):
        if i % width:
            out[i] = (out[i] + out[i - 1]) % 256
    return bytes(out), width, height


def test_text_media_by_another_reader(spark, documents):
    rows, df = documents
    stored = {r["doc_id"]: bytes(r["media"]) for r in tiff.encode_texts(df).collect() if r["doc_id"] is not None}
    text = {r[0]: (r[1] or "").encode() for r in rows}
    for r in tiff.text_media(df).collect():
        if r["doc_id"] is None or r["doc_id"] == 2:  # more than one row
            continue
        media = stored[r["doc_id"]]
        pixels, width, height = slow_pixels(media)
        assert pixels.rstrip(b"\0") == text[r["doc_id"]].rstrip(b"\0") and len(pixels) % 64 == 0
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        size, mean, spread, bins = r["feature"].split(";")
        average = sum(pixels) / len(pixels)
        deviation = math.sqrt(sum((x - average) ** 2 for x in pixels) / len(pixels))
        assert size == f"{width}x{height}" and float(mean) == pytest.approx(average, abs=1e-3) and float(spread) == pytest.approx(deviation, abs=1e-3)
        share = Counter(x // 16 for x in pixels)
        assert all(abs(got - 255 * share[k] / len(pixels)) <= 0.51 for k, got in enumerate(bytes.fromhex(bins)))
