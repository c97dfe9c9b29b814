"""Operators without a fixed result, and the parts of methods that queries don't reach."""

import fnmatch
import json
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from readsieve.llm import chat_tools, components, decontam, langid, pii, queries, simhash, tiff, url_rules
from readsieve.storage import Workspace

from ..oracles import assert_same, connection
from .data import SMALL, frame, odd_documents, small

# -- urls


def test_automaton_equals_fnmatch():
    rng = random.Random(2)
    globs = tuple("".join(rng.choice("ab?*") for _ in range(rng.randrange(0, 9))) for _ in range(60)) + ("a" * 70 + "*" + "b" * 70, "*é", "")
    strings = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(300)] + ["", "a" * 70 + "xx" + "b" * 70, "aé", "aü"]
    found = url_rules.Automaton(globs).fits(strings)
    assert found.tolist() == [[fnmatch.fnmatchcase(s, g) for g in globs] for s in strings]


def test_url_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?y=/en/1": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org": ("notexample.org", "", None, "allow"),
        "x://y.com/de/": ("y.com", "/de/", "com/de/", "block"),
        "x://casino-a.net/fr/": ("casino-a.net", "/fr/", None, "block"),
        "x://casino-a.com/fr/": ("casino-a.com", "/fr/", "com/fr/", "allow"),
        "no scheme.org/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://b.org/c://d.com/de/": ("b.org", "/c://d.com/de/", "org/", "allow"),
        "a://É.org/" + "x" * 20_000: ("É.org", "/" + "x" * 20_000, "org/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "x", "clash") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "x", "clash"), (None, None, None, None)], "page_id long, url string, html string, host string")
    out = url_rules.judge(df).collect()
    for i, expected in enumerate(cases.values()):
        assert {tuple(r)[1:5] for r in out if r["page_id"] == i} == {expected}
    assert len(out) == len(cases) + 2
    assert url_rules.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert assert_same(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], connection()) > 0


# -- media


def tiff_file(pages, order="<"):
    """pages: tags (name -> values, all LONG or SHORT) and the strips or tiles."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))
    link = 4
    for tags, parts in pages:
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part + b"\0" * (len(part) % 2)
        place = {tiff.TILE_OFFSETS: tiff.TILE_COUNTS, tiff.STRIP_OFFSETS: tiff.STRIP_COUNTS}
        which = tiff.TILE_OFFSETS if tiff.TILE_WIDTH in tags else tiff.STRIP_OFFSETS
        tags = {**tags, which: offsets, place[which]: [len(p) for p in parts]}
        entries = b""
        for tag, values in sorted(tags.items()):
            values = values if isinstance(values, list) else [values]
            data = struct.pack(f"{order}{len(values)}I", *values)
            if len(data) > 4:
                where, out = len(out), out + data
                data = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + data
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("compression", "pack"), [(1, bytes), (8, zlib.compress), (32946, zlib.compress), (5, tiff.pack_lzw), (32773, tiff.pack_bits)])
@pytest.mark.parametrize("layout", ["strips", "tiles", "planar"])
def test_layouts(order, compression, pack, layout):
    rng = np.random.default_rng(4)
    pages, truth = [], []
    for size in (1, 2, 4):
        for predictor in (1, 2) if size < 4 else (1, 2, 3):
            height, width, samples = 21, 19, 3
            pixels = rng.integers(0, 7, (height, width, samples)).cumsum(axis=1).astype(f"<u{size}")
            tags = {256: width, 257: height, 258: [8 * size] * samples, 259: compression, 277: samples, 317: predictor}
            blocks = []
            if layout == "tiles":
                tags |= {322: 16, 323: 16}
                whole = np.zeros((32, 32, samples), pixels.dtype)
                whole[:height, :width] = pixels
                blocks = [whole[y : y + 16, x : x + 16] for y in (0, 16) for x in (0, 16)]
            elif layout == "strips":
                tags[278] = 8
                blocks = [pixels[y : y + 8] for y in range(0, height, 8)]
            else:
                tags |= {278: 8, 284: 2}
                blocks = [pixels[y : y + 8, :, s : s + 1] for s in range(samples) for y in range(0, height, 8)]
            parts = []
            for block in blocks:
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                data = np.ascontiguousarray(block.astype(f"{order}u{size}"))
                if predictor == 3:  # bytes of all samples, high ones first, differenced along the row
                    rows = np.ascontiguousarray(block.astype(f">u{size}")).view(np.uint8).reshape(len(block), -1, size)
                    rows = rows.transpose(0, 2, 1).reshape(len(block), -1)
                    own = block.shape[2]
                    data = rows.copy()
                    data[:, own:] -= rows[:, :-own]
                parts.append(pack(data.tobytes()))
            pages.append((tags, parts))
            truth.append(pixels.tobytes())
    assert [p.pixels for p in tiff.read(tiff_file(pages, order))] == truth


def test_bilevel_and_codecs():
    rows = np.random.default_rng(1).integers(0, 256, (5, 3), dtype=np.uint8)
    page = next(tiff.read(tiff_file([({256: 21, 257: 5, 258: 1, 259: 32773, 278: 2}, [tiff.pack_bits(rows[y : y + 2].tobytes()) for y in (0, 2, 4)])])))
    assert page.pixels == rows.tobytes()
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 300, 40_000):
        for letters in (2, 3, 256):
            data = bytes(rng.randrange(letters) for _ in range(n))
            assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data == tiff.unpack_bits(tiff.pack_bits(data))


def test_pages(spark):
    payloads = [bytes(64), b"x" * 640]
    good = tiff.write(payloads)
    loop = bytearray(tiff.write(payloads[:1]))
    struct.pack_into("<I", loop, 8 + 2 + 120, 8)
    cases = [good, None, b"", b"not a tiff", good[:-5], bytes(loop), good]
    df = spark.createDataFrame([(i, m, 9) for i, m in enumerate(cases)], "doc_id long, media binary, page int")
    out = tiff.read_pages(df).collect()
    rows = lambda i: sorted((r["page"], r["pixels"] and bytes(r["pixels"])) for r in out if r["doc_id"] == i)
    whole = [(0, payloads[0]), (1, payloads[1])]
    assert rows(0) == rows(6) == whole and rows(1) == rows(2) == []
    assert rows(3) == [(-1, None)] and rows(4) == [(-1, None), (0, payloads[0])] and rows(5) == whole[:1]
    assert tiff.read_pages(df.limit(0)).count() == 0


def test_codecs_of_the_specifications():
    """The examples printed in TIFF 6.0 (LZW) and in the note that defines PackBits."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes).ljust(88, "0")
    packed = int(bits, 2).to_bytes(11, "big")
    assert tiff.unpack_lzw(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    assert tiff.unpack_bits(packed) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22" + " AA" * 10)
    assert tiff.unpack_bits(b"\x80\x00z") == b"z"  # 128 stands for nothing
    # one 2 x 2 page, byte for byte
    page = bytes.fromhex("4949 2A00 08000000 0700 0001 0300 01000000 02000000 0101 0300 01000000 02000000 0201 0300 01000000 08000000 0301 0300 01000000 01000000 1101 0400 01000000 62000000 1601 0300 01000000 02000000 1701 0400 01000000 04000000 00000000".replace("0001 0300", "0001 0300"))
    assert [p.pixels for p in tiff.read(page + b"abcd")] == [b"abcd"]


def test_faulty_media(spark):
    good = ({256: 4, 257: 4, 258: 8, 259: 1, 278: 4}, [bytes(range(16))])
    bomb = zlib.compress(bytes(50_000_000), 9)
    cases = {
        "width": ({**good[0], 256: 0}, good[1]),
        "height": ({**good[0], 257: 0}, good[1]),
        "samples": ({**good[0], 277: 0}, good[1]),
        "strip": ({**good[0], 278: 0}, good[1]),
        "tile": ({256: 4, 257: 4, 258: 8, 259: 1, 322: 0, 323: 0}, good[1]),
        "no tile height": ({256: 4, 257: 4, 258: 8, 259: 1, 322: 4}, good[1]),
        "huge": ({**good[0], 256: 200_000, 257: 200_000, 278: 200_000}, good[1]),
        "wide": ({**good[0], 256: 30_000, 257: 30_000, 259: 8, 278: 30_000}, [zlib.compress(b"x")]),
        "missing strips": ({**good[0], 278: 1}, good[1]),
        "deflate": ({**good[0], 259: 8}, [b"no deflate stream"]),
        "cut": ({**good[0], 259: 8}, [zlib.compress(bytes(range(16)))[:9]]),
        "lzw": ({**good[0], 259: 5}, [b"\xff" * 9]),
        "kind": ({**good[0], 259: 7}, good[1]),
        "no strips": ({256: 4, 257: 4, 258: 8}, []),
    }
    media = [(name, tiff_file([page])) for name, page in cases.items()] + [("good then bad", tiff_file([good, cases["width"]])), ("bomb", tiff_file([({**good[0], 259: 8}, [bomb])])), ("good", tiff_file([good]))]
    out = tiff.read_pages(spark.createDataFrame(media, "name string, media binary")).collect()
    assert sorted((r["name"], r["page"]) for r in out) == sorted([(name, -1) for name in cases] + [("good then bad", 0), ("good then bad", -1), ("bomb", 0), ("good", 0)])
    assert all((r["error"] is None) == (r["page"] >= 0) for r in out)
    assert {bytes(r["pixels"]) for r in out if r["name"] in ("good", "good then bad") and r["page"] == 0} == {bytes(range(16))}
    assert next(bytes(r["pixels"]) for r in out if r["name"] == "bomb") == bytes(16)


# -- chat


def test_tool_calls(spark):
    tool = {"add": {"x": ("number", True), "y": ("integer", True), "z": ("string", False)}}
    calls = [
        {"id": "a", "name": "add", "arguments": {"y": 2, "x": 1.5}, "after": ["b"]},
        {"id": "b", "name": "add", "arguments": {"x": "no"}},
        {"id": "c", "name": "nope", "arguments": {}, "after": ["d"]},
        {"id": "d", "name": "add", "arguments": {"x": 1, "y": 2, "z": "é\n\""}, "after": ["c", "zz"]},
        {"id": "e", "name": "add", "arguments": [1], "after": ["a"]},
        {"id": "f", "name": "add", "arguments": {"x": 1, "y": 1.5, "z": 1}, "after": ["e", "b"]},
    ]
    messages = [
        (1, 1, "assistant", json.dumps({"tool_calls": calls})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "3"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "3"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "q", "content": "4"})),
        (2, 0, "user", None),
        (2, 1, "assistant", "x"),
        (None, 0, "user", "lost"),
        (None, 1, "assistant", "lost"),
        (3, 0, "user", "{not json"),
    ]
    df = spark.createDataFrame([(*m, 1) for m in messages], "conv_id long, turn long, role string, text string, level int")
    out = chat_tools.format_conversations(df, chat_tools.DIALOGUE | tool).collect()
    found = {(r["conv_id"], r["call_id"], r["status"]): (r["level"], r["valid"], r["problems"]) for r in out}
    assert found == {
        (1, "a", "linked"): (1, True, ""),
        (1, "a", "extra_result"): (None, False, ""),
        (1, "b", "no_result"): (0, False, "x,y"),
        (1, "c", "cycle"): (None, False, "tool"),
        (1, "d", "cycle"): (None, False, "after"),
        (1, "e", "no_result"): (2, False, "arguments"),
        (1, "f", "no_result"): (3, False, "y,z"),
        (1, "q", "orphan_result"): (None, False, ""),
        (2, "turn-0", "linked"): (0, False, "text"),
        (None, "turn-0", "no_result"): (0, True, ""),
        (None, "turn-0", "orphan_result"): (None, False, ""),
        (3, "turn-0", "no_result"): (0, True, ""),
    }
    for r in out:
        data = json.loads(r["json"])
        assert r["json"] == json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert chat_tools.format_conversations(df.limit(0)).count() == 0


def test_numbers_keep_type_and_value(spark):
    tool = {"add": {"x": ("integer", True)}}
    forms = {
        "1e2": "100", "100": "100", "100.0": "100", "1.0E+2": "100", "-0": "0", "-0.0e5": "0", "0.10": "0.1", "1.5e-3": "0.0015", "-12.340": "-12.34",
        "12345678901234567890123456789012345678": "12345678901234567890123456789012345678", "123456789012345678901e-3": "123456789012345678.901",
        "1e37": "1" + "0" * 37, "1e38": None, "1e400": None, "12345678901234567890123456789012345678901": None, "1e-39": None, "1e99999999999": None, "0e99999999999": "0",
    }
    calls = [(1, str(i), 1, "add", '{"s" : "a\\\\ 1e2 \\" 1.50", "x": %s}' % n, None) for i, n in enumerate(forms)]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    text = r'"a\\ 1e2 \" 1.50"'
    whole = {True: "", False: "x", None: "arguments"}
    said = [json.dumps({"tool_calls": [{"id": i, "name": "add", "arguments": 0}]}).replace('"arguments": 0', '"arguments": ' + a) for _, i, _, _, a, _ in calls]
    messages = spark.createDataFrame([(1, 1, "assistant", t) for t in said] + [(1, 2, "tool", '{"tool_call_id": 1e400, "content": 1.50}')], "conv_id long, turn long, role string, text string")
    for out in (chat_tools.link(df, results, tool), chat_tools.format_conversations(messages, tool)):
        found = {r["call_id"]: r for r in out.collect()}
        for i, form in enumerate(forms.values()):
            r, kind = found[str(i)], None if form is None else "." not in form
            assert r["problems"] == whole[kind]
            assert r["json"].startswith('{"arguments":' + (f'{{"s":{text},"x":{form}}}' if form else "null") + ',"id"')
    assert (found["1e400"]["status"], json.loads(found["1e400"]["json"])["result"]) == ("orphan_result", "1.5")


def test_results_of_repeated_and_unknown_ids(spark):
    """Random calls and results, a hot id and nulls among them, against a plain version."""
    rng = random.Random(11)
    pick = lambda: (rng.choice([1, 2, None]), rng.choice(["hot", "hot", None, *"abcdefghij"]))
    calls = [(*pick(), rng.randrange(3), "x", "{}", None) for _ in range(40)]
    results = [(*pick(), rng.choice([0, 1, None]), rng.choice(["", "p", "q", None])) for _ in range(80)] + [(7, "only", 1, "z"), (8, "once", 1, "z")]
    calls += [(8, "once", 0, "x", "{}", None), (8, "never", 0, "x", "{}", None)]
    order = lambda r: tuple((v is not None, v) for v in r)
    of = {}
    for conv, call, *rest in results:
        of.setdefault((conv, call), set()).add(tuple(rest))
    called = {(c[0], c[1]) for c in calls if None not in c[:2]}
    expected = []
    for conv, call, turn, *_ in calls:
        own = sorted(of.get((conv, call), ()), key=order) if (conv, call) in called else []
        expected.append((conv, call, turn, own[0][0] if own else None, "linked" if own else "no_result", len(own), own[0][1] if own else None))
    for key, own in of.items():
        for i, (turn, content) in enumerate(sorted(own, key=order)):
            if key not in called or i:
                expected.append((*key, None, turn, "extra_result" if key in called else "orphan_result", 1 if None in key else len(own), content))
    columns = "conv_id long, call_id string, turn long, "
    out = chat_tools.link(
        spark.createDataFrame(calls, columns + "name string, arguments string, after array<string>"), spark.createDataFrame(results, columns + "content string"), {"x": {}}
    ).collect()
    found = [(*(r[c] for c in ("conv_id", "call_id", "call_turn", "result_turn", "status", "n_results")), json.loads(r["json"]).get("result")) for r in out]
    assert sorted(found, key=order) == sorted(expected, key=order)
    assert {"linked", "no_result", "extra_result", "orphan_result"} == {r[4] for r in expected}


def slow_levels(calls):
    """calls: conv, id, turn, after. Level of each (conv, id) by repeated passes; None on or behind a cycle."""
    turns = {}
    for conv, call, turn, _ in calls:
        turns.setdefault((conv, call), set()).add(turn)
    waits = {}
    for conv, call, turn, after in calls:
        waits.setdefault((conv, call), set())
        waits[conv, call] |= {(conv, b) for b in after if any(t >= turn for t in turns.get((conv, b), ()))}
    level = {k: 0 for k, own in waits.items() if not own}
    while new := {k: 1 + max(level[b] for b in own) for k, own in waits.items() if k not in level and all(b in level for b in own)}:
        level |= new
    return {k: level.get(k) for k in waits}


@pytest.mark.parametrize("gathered", [2000, 5])
def test_levels(spark, monkeypatch, gathered):
    monkeypatch.setattr(chat_tools, "GATHERED", gathered)
    rng = random.Random(6)
    calls = [(conv, f"c{rng.randrange(8)}", rng.randrange(3), [f"c{rng.randrange(9)}" for _ in range(rng.randrange(3))]) for conv in range(40) for _ in range(10)]
    df = spark.createDataFrame([(c, i, t, "x", "{}", a) for c, i, t, a in calls], "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    out = chat_tools.link(df, results, {"x": {}}).collect()
    assert len(out) == len(calls)
    expected = slow_levels(calls)
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in out} == expected
    assert {None, 0, 1, 2} <= set(expected.values())
    assert all((r["status"] == "cycle") == (r["level"] is None) for r in out)


def test_level_ladder(spark):
    """Each call waits for the two before: as many rounds as calls."""
    n = 1010
    df = spark.createDataFrame([(1, f"c{i:04d}", 1, "x", "{}", [f"c{k:04d}" for k in (i - 1, i - 2) if k >= 0]) for i in range(n)], "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    assert 2 * n - 3 < chat_tools.GATHERED  # within its row
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    began = time.monotonic()
    out = chat_tools.link(df, results, {"x": {}}).collect()
    assert sorted((r["call_id"], r["level"]) for r in out) == [(f"c{i:04d}", i) for i in range(n)]
    assert time.monotonic() - began < 60



@pytest.mark.parametrize("gathered", [2000, 5])
def test_long_chain_of_calls(spark, monkeypatch, gathered):
    monkeypatch.setattr(chat_tools, "GATHERED", gathered)
    calls = [(1, f"c{i}", 1, "x", json.dumps({"text": "y" * (100_000 if i == 3 else 1)}), [f"c{i - 1}"] if i else []) for i in range(1000)]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    began = time.monotonic()
    out = chat_tools.link(df, results, {"x": {}}).collect()
    assert {r["call_id"]: r["level"] for r in out} == {f"c{i}": i for i in range(1000)}
    assert time.monotonic() - began < 30 and max(len(r["json"]) for r in out) > 100_000


def test_no_turn_vanishes(spark):
    messages = [
        (1, 0, "user", "asked"), (1, 1, None, "answered"), (2, 1, None, "alone"), (3, 0, None, None),
        (4, 0, "user", json.dumps({"tool_calls": []})), (4, 1, "assistant", json.dumps({"tool_calls": [], "content": "x"})), (5, 1, None, json.dumps({"tool_calls": []})),
        (6, 1, None, json.dumps({"tool_calls": [], "tool_call_id": "q", "content": "y"})),
    ]
    out = chat_tools.format_conversations(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"], r["call_id"], r["call_turn"], r["result_turn"], r["status"]) for r in out) == [
        (1, "turn-0", 0, 1, "linked"),
        (2, "turn-0", None, 1, "orphan_result"),
        (3, "turn--1", None, 0, "orphan_result"),
        (4, "turn-0", 0, 1, "linked"),
        (5, "turn-0", None, 1, "orphan_result"),
        (6, "q", None, 1, "orphan_result"),
    ]
    assert json.loads(next(r["json"] for r in out if r["conv_id"] == 1))["result"] == "answered"


# -- decontamination


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + (kind != 1)] = [] if kind == 2 else [f"new{rng.randrange(999)}"]
    return words


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, t) for i, t in small("benchmark", "item_id, text")] + [(900, "Just four words here"), (901, None), (902, "..."), (None, "an item with no number but with enough words to be one")]
    docs, planted = [], []
    for k in range(240):
        item = items[rng.randrange(40)][1]
        own = decontam.words_of(item.encode())
        text = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(text) + 1)
        text[at:at] = edited(rng, [w.decode() for w in own], rng.randrange(0, int(0.3 * len(own)) + 1))
        docs.append((10_000 + k, " ".join(text).upper() if k % 2 else ", ".join(text), None, None, None))
    docs += [(700, "say JUST, four words here!", None, None, None), (701, "just five words here", None, None, None), *odd_documents()]
    expected = set()
    for doc, text, *_ in docs:
        own = decontam.words_of(text.encode()) if text else []
        for item_id, item in items:
            of = decontam.words_of(item.encode()) if item else []
            if of and slow_distance(of, own) <= decontam.most_edits(len(of)):
                expected.add((doc, item_id))
    items = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    found = decontam.find(df, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} <= expected
    assert len({(r["doc_id"], r["item_id"]) for r in found}) >= 0.97 * len(expected) > 100
    assert (700, 900) in expected and (701, 900) not in expected
    bad = {r["doc_id"] for r in found}
    kept = decontam.clean(df, items)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, *_ in docs if d not in bad), key=str)
    assert decontam.find(df, items.limit(0)).count() == decontam.find(df.limit(0), items).count() == 0
    assert decontam.clean(df, items.limit(0)).count() == len(docs)


def test_decontamination_in_blocks(spark, monkeypatch):
    df, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    key = lambda: sorted((r["doc_id"], r["item_id"]) for r in decontam.find(df, items).collect())
    whole = key()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(decontam, "CELLS_TOGETHER", 500)
    assert len(list(decontam.blocks(items))) > 3 and key() == whole != []
    texts = small(columns="doc_id, text")
    exact = {(d, i) for d, t in texts for i, x in small("benchmark", "item_id, text") if x in t}
    assert exact <= set(whole)


@pytest.mark.parametrize("most", [512, 1])
def test_no_bound_on_repetitions_loses_items(monkeypatch, most):
    """Items that no number of repetitions finds are compared with every window."""
    monkeypatch.setattr(decontam, "MOST_REPETITIONS", most)
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(10 + i % 30)).encode()) for i in range(60)]
    index = decontam.Index(items)
    assert bool(index.exact) == (most == 1) and all(n >= decontam.LEAST_TRIALS for n, _ in index.trials.values())
    texts, truth = [], []
    for t in range(300):
        own = items[rng.randrange(60)]
        n = len(own[1].split())
        texts.append(" ".join(["x"] * rng.randrange(20) + edited(rng, own[1].decode().split(), decontam.most_edits(n)) + ["y"] * 9).encode())
        truth.append((t, own[0]))
    found = {(t, items[k][0]) for t, k, *_ in index.search(texts)}
    assert len(found & set(truth)) >= (1 if most == 1 else 0.97) * len(truth)


def test_clashing_columns_and_recall(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i * 20 + k}" for k in range(20)), 1) for i in range(30)], "item_id long, text string, distance int")
    docs = spark.createDataFrame([(i, "so " + " ".join(f"w{i * 20 + k}" for k in range(20)), 7, "x", 0.5) for i in range(40)], "doc_id long, text string, distance int, item_id string, similarity double")
    out = decontam.find(docs, items)
    assert out.columns == ["doc_id", "item_id", "first_word", "end_word", "distance", "similarity"]
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in out.collect()) == [(i, i, 0) for i in range(30)]
    assert sorted(map(tuple, decontam.clean(docs, items).collect())) == sorted(map(tuple, docs.where("doc_id >= 30").collect()))
    ((words, trials, found),) = decontam.recall(items)
    assert words == 20 and trials == decontam.MOST_TRIALS and found >= decontam.RECALL * trials


# -- components


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 90)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2060), rng.randrange(2060, 2120)) for _ in range(40)] + [(-9, 3), (5000, 5001)] * 3
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    work = Workspace(spark, "test")
    out = components.connected_components(spark.createDataFrame(links, "u long, v long"), work).collect()
    assert {r["node"]: r["component"] for r in out} == {n: root(n) for n in parent} and len(out) == len(parent)
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), work).count() == 0


# -- pipeline


def test_pipeline(spark, tmp_path):
    odd = [r for r in odd_documents() if r[0] is None or r[0] < 60]
    rest = [(1000 + d, t, lang, s, n) for d, t, lang, s, n in small(columns="doc_id, text, lang, source, n_chars")]
    spark.createDataFrame(odd + rest, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, tables, work = docs.columns, [docs], Workspace(spark, "test")
    for _, stage in corpus_pipeline.STAGES:
        tables.append(work.save(stage(spark, tables[-1], str(tmp_path))))
    rows = [[tuple(r) for r in t.select(*columns).collect()] for t in tables[:-1]]
    # language: texts without letters go, real texts stay
    gone = {r[1] for r in rows[0]} - {r[1] for r in rows[1]}
    assert not any(t and any(c.isalpha() for c in t) and len(t) > 300 for t in gone)
    assert all(r[1] and any(c.isalpha() for c in r[1]) for r in rows[1])
    # near-duplicates: the least of each component
    label = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(tables[1]).collect()}
    assert sorted(map(repr, (r[0] for r in rows[2]))) == sorted(map(repr, set(label.values())))
    assert set(rows[2]) <= set(rows[1])
    # decontamination
    bad = {r["doc_id"] for r in decontam.find(tables[2], spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert bad and sorted(map(repr, rows[3])) == sorted(repr(r) for r in rows[2] if r[0] not in bad)
    # personal data: base spans are gone, other rows are as they were
    assert pii.report(tables[4]).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    before = {r[0]: r for r in rows[3]}
    assert len(rows[4]) == len(rows[3]) and any(r != before[r[0]] for r in rows[4])
    assert all(r == before[r[0]] or "[" in r[1] and r[4] == len(r[1]) for r in rows[4])
    # packing
    packed = tables[5]
    assert packed.select("doc_id").distinct().count() == len({r[0] for r in rows[4]})
    run = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*key).collect()), key=repr) == sorted(map(tuple, packed.select(*key).collect()), key=repr)
    assert public_tokenizers.path(corpus_pipeline.TOKENIZER)


@pytest.mark.parametrize("most", [512, 2])
def test_recall_of_each_length(monkeypatch, most):
    """Few short items among many long ones are found as surely, by keys or, where these would not do, by their runs."""
    monkeypatch.setattr(decontam, "MOST_REPETITIONS", most)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    lengths = [50] * 800 + [n for n in (5, 6, 7, 9, 14) for _ in range(8)]
    items = [(i, " ".join(word() for _ in range(n)).encode()) for i, n in enumerate(lengths)]
    index = decontam.Index(items)
    assert set(index.trials) == {5, 6, 7, 9, 14, 50} and all(found >= decontam.RECALL * n for n, found in index.trials.values())
    assert bool(index.exact) == (most == 2)
    for n in (5, 6, 7, 9, 14, 50):
        own = [i for i, size in enumerate(lengths) if size == n]
        truth = [rng.choice(own) for _ in range(400 if n < 50 else 150)]
        texts = [" ".join([word() for _ in range(rng.randrange(20))] + edited(rng, items[k][1].decode().split(), decontam.most_edits(n)) + [word() for _ in range(9)]).encode() for k in truth]
        found = {(t, k) for t, k, *_ in index.search(texts)}
        missed = sum((t, k) not in found for t, k in enumerate(truth))
        assert missed <= 0.01 * len(truth), n


def test_every_label_is_learned(spark):
    """Two thousand labels, the rarest of one row; one row many times repeated takes no other's place."""
    rng = random.Random(4)
    code = lambda k: "".join(chr(97 + k // 13**j % 13) for j in range(3))
    said = lambda k: " ".join(code(k) + chr(110 + rng.randrange(3)) for _ in range(6))
    ids = [i for i in range(1, 20_000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids.pop(), said(k), f"l{k:04}", None, None) for k in range(2000) for _ in range(1 + k % 3)]
    rows += [(ids[0], said(7), "l0007", None, None)] * 3000
    df = frame(spark, rows).repartition(4)
    work = Workspace(spark, "langid", langid.LONG_ROWS)
    model = langid.train(df.where(langid.learned_from()), work)
    assert model.labels == sorted({r[2] for r in rows}) and model.features * len(model.labels) <= langid.MODEL_CELLS
    out = [model.predict(t)[0] == lang for _, t, lang, *_ in rows[:4000:4]]
    assert model.weights.any(axis=0).all() and sum(out) > 0.5 * len(out)


def test_calls_as_users_have_them(spark):
    """Both call forms, arguments as objects and as strings; nothing follows JSON, and no text of a turn is lost."""
    schemas = {"look": {"x": ("integer", True)}}
    call = lambda i, arguments: {"id": i, "type": "function", "function": {"name": "look", "arguments": arguments}}
    first = {"content": "let me look", "tool_calls": [call("a", '{"x": 1e2}'), call("b", {"x": 5}), {"id": "c", "name": "look", "arguments": '{"x":1} junk'}, {"id": "d", "name": "look", "arguments": {"x": 2.0}}]}
    bad = ['{"x":1}] [', '{"x":1},{"x":2}', '"text"', "", "[1]", '{"x":1}{"x":2}', "null"]
    turns = [
        ("user", '{"x":1} and then prose'),
        ("assistant", json.dumps(first)),
        ("tool", json.dumps({"tool_call_id": "a", "content": "found"})),
        ("user", json.dumps({"content": "please", "tool_calls": [call(f"bad{i}", text) for i, text in enumerate(bad)]})),
        ("assistant", '{"x":1}] ['),
        ("assistant", json.dumps({"content": "", "tool_calls": [call("e", None), {"id": "f", "name": "look"}]})),
    ]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = {r["call_id"]: r for r in chat_tools.format_conversations(df, schemas | chat_tools.DIALOGUE).collect()}
    said = {k: json.loads(r["json"]) for k, r in out.items()}
    assert [said[k]["arguments"] for k in "abcd"] == [{"x": 100}, {"x": 5}, None, {"x": 2}]
    assert [out[k]["valid"] for k in "abcd"] == [True, True, False, True] and out["c"]["problems"] == "arguments"
    assert all(out[k]["problems"] == "arguments" for k in [f"bad{i}" for i in range(len(bad))] + ["e", "f"])
    assert said["turn-0"]["arguments"]["text"] == turns[0][1] and said["turn-0"]["result"] == "let me look"
    assert said["turn-3"]["arguments"]["text"] == "please" and said["turn-3"]["result"] == turns[4][1]
    assert said["a"]["result"] == "found" and len(out) == 4 + len(bad) + 2 + 2
