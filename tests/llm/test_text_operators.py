"""Operators that handle one row at a time: 1, 2, 3, 5, 6, and 9."""

import random
import zlib

import numpy as np
import pytest

from siltstone.llm import decontaminate, language_id, license_scan, packing, secret_scan, token_binary, tokens

TEXTS = [
    "The quick, brown fox; don't!", "", "   ", "A B c\x1cd\x85e", "İstanbul ΣΑΣ ﬁ é ́x", "Zürich. été, 12.5% a.b.c ... '' 's x's.", "<|endoftext|> <|ENDOFTEXT|>a",
    "日本語 テスト 한국어", "a" * 5000, "\r\n\v\fmixed   white", "WORD. word, Word.", "é». a». «b",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


def test_chunks_equal_the_library(library):
    coder = tokens.ChunkEncoder(tokens.vocabulary(), limit=3)
    assert not coder.whole
    for _ in range(3):
        got = coder.encode([t.encode() for t in TEXTS])
        assert [g + b"\x01\0\0\0" for g in got] == [ids_of(library, t) for t in TEXTS]


def test_other_vocabularies_are_encoded_whole():
    coder = tokens.ChunkEncoder(tokens.vocabulary("byte_bpe_50k.json"))
    assert coder.whole
    expected = coder.tokenizer.encode(TEXTS[0], add_special_tokens=False).ids
    assert coder.encode([TEXTS[0].encode()]) == [np.array(expected, "<u4").tobytes()]


def brute_fill(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_closest_fill_is_optimal():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(12))]
        room = rng.randrange(1, 100)
        counts = {x: lengths.count(x) for x in lengths}
        chosen = packing.closest_fill(counts, room)
        assert all(0 < c <= counts[k] for k, c in chosen.items())
        assert sum(k * c for k, c in chosen.items()) == brute_fill(lengths, room)


def check_packed(rows, documents, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for doc_id, ids in documents.items():
        joined = b"".join(bytes(r["ids"]) for r in sorted(by_doc[doc_id], key=lambda r: r["start"]))
        assert joined == ids and all(r["doc_tokens"] == len(ids) // 4 for r in by_doc[doc_id])
        assert sorted(r["start"] for r in by_doc[doc_id])[0] == 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


def test_packing(spark, odd_docs, no_docs, library):
    once = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    documents = {r["doc_id"]: ids_of(library, r["text"]) for r in once.collect()}
    check_packed(packing.pack(once.repartition(3)).collect(), documents)
    check_packed(packing.pack(once.coalesce(1), capacity=64, buffer_tokens=256).collect(), documents, 64)
    assert packing.pack(odd_docs).selectExpr("sum(length) n").first()["n"] == sum(len(ids_of(library, r["text"])) // 4 for r in odd_docs.collect())
    assert packing.pack(no_docs).count() == 0


def test_packing_of_equal_lengths_pads_nothing(spark, library):
    docs = spark.createDataFrame([(i, "word " * 699) for i in range(100)], "doc_id long, text string").coalesce(1)
    check_packed(packing.pack(docs, buffer_tokens=5000).collect(), {i: ids_of(library, "word " * 699) for i in range(100)})


def test_token_binary_round_trip(spark, odd_docs, no_docs, library, tmp_path):
    manifest = token_binary.write(odd_docs, path=str(tmp_path), frame_bytes=2000)
    rows = token_binary.read(manifest).orderBy("start").collect()
    expected = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(rows, expected, strict=True):
        assert (r["doc_id"], r["start"], bytes(r["ids"])) == (doc_id, at, ids_of(library, text)) and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    some = token_binary.read(manifest, [5, 24]).collect()
    assert {r["doc_id"]: zlib.crc32(r["ids"]) for r in some} == {r["doc_id"]: zlib.crc32(r["ids"]) for r in rows if r["doc_id"] in (5, 24)}
    assert token_binary.read(token_binary.write(no_docs)).count() == 0


def test_token_binary_splits_one_doc_id(spark, library, tmp_path):
    texts = [f"text {i} of no id" for i in range(300)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(7, "last")], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_binary.write(docs, path=str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.docs for r in manifest.collect()) < 200
    rows = token_binary.read(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 300 + [7]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(301)]
    assert {bytes(r.ids) for r in rows} == {np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in [*texts, "last"]}


def test_shard_reads_only_what_is_asked_and_finds_damage(tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    writer = token_binary.ShardWriter(out, frame_bytes=400)
    documents = [(i, np.full(i % 7 * 20 + 1, i, "<u4").tobytes()) for i in range(50)]
    for doc_id, ids in documents:
        writer.add(doc_id, ids)
    writer.close()
    data = out.getvalue()
    reader = token_binary.ShardReader(io.BytesIO(data), len(data))
    assert [(d, ids) for _, d, ids in reader.documents()] == documents
    again = token_binary.ShardReader(io.BytesIO(data), len(data))
    assert [d for _, d, _ in again.documents([40])] == [40] and again.frames_read == 1 and len(again.frames) > 5
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"".join(ids for _, ids in documents)
    spoilt = bytearray(data)
    spoilt[int(again.starts[2]) + 12] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017, PT011  the frame or its checksum
        list(token_binary.ShardReader(io.BytesIO(bytes(spoilt)), len(data)).documents())
    with pytest.raises(ValueError, match="seek table"):
        token_binary.ShardReader(io.BytesIO(data[:-1]), len(data) - 1)


def test_language_is_learned_and_held_out(spark, odd_docs, no_docs):
    rng = random.Random(2)
    syllables = {"aa": ["the", "ing", "wor", "lth", "and"], "bb": ["der", "sch", "ung", "ein", "ich"], "cc": ["que", "ción", "los", "ñar", "del"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(rng.randrange(3, 30))), x) for i in range(400) for x in [rng.choice("abc") * 2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where(~language_id.held_out()))
    out = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert 40 < len(held) < 120 and np.mean([out[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd_docs, model).collect()}
    assert odd[20] == odd[21] == odd[22] == odd[23] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in odd.values()) and odd[28][0] == "aa"
    assert language_id.identify(no_docs, model).count() == 0
    kept = language_id.accepted(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 4
    nothing = language_id.train(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}


def test_masks_hold_every_language_of_a_gram():
    grams = {"x": np.arange(500, dtype=np.uint64), "y": np.arange(250, 900, dtype=np.uint64)}
    model = language_id.LanguageModel.build(grams, 4, 1 << 14, 3)
    masks = model.masks(np.arange(900, dtype=np.uint64))
    assert all(masks[:500] & np.uint64(1)) and all(masks[250:900] & np.uint64(2))
    absent = model.masks(np.arange(10_000, 60_000, dtype=np.uint64))
    assert abs(np.mean(absent & np.uint64(1)) - model.fpr[0]) < 0.01


SECRETS = [
    None, "", "token = abc", "Token: 'abcdef1234' and PASSWORD=\"x.y/z+1=\"", "AKIA" + "A" * 16 + " AKIAAKIA1 AKIA" + "B" * 15, "f" * 23 + " " + "0a" * 12 + "Z" + "e" * 30,
    "api_key:secret=abcdefg apikey  =  'zzzzzz", "é" * 5 + "secret:abcdef", "toKen=abcdefgh", "passwd=" + "a" * 30, "ghp_" + "a1" * 20 + " -----BEGIN RSA PRIVATE KEY-----",
    "ftp://joe:pw123@host eyJabcdefgh.abcdefgh.abcdefgh", "x" * 100_000 + " token=abcdef",
]


def test_secrets_equal_a_full_scan(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan(docs)).collect()}
    for i, text in enumerate(SECRETS):
        spans, digest = secret_scan.brute_force(text)
        assert out[i]["base_sha256"] == digest
        assert [sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")] == [out[i]["n_assign"], out[i]["n_access"], out[i]["n_hex"]]
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(out[i]["spans"].split(","))
    assert "vcs_token" in out[10]["spans"] and "private_key" in out[10]["spans"] and "url_login" in out[11]["spans"] and "jwt" in out[11]["spans"]
    assert out[8]["n_assign"] == 0
    assert secret_scan.scan(odd_docs).count() == odd_docs.count() and secret_scan.scan(no_docs).count() == 0


@pytest.mark.parametrize("unit", ["eyJ", "eyJaaaaaaaa.", "password=", "AKIA", "a.b:", "bearer ", "ab://c:", "f", "ghp_", "token   "])
def test_secret_rules_take_linear_time(unit):
    import time

    scanner = secret_scan.TrigramScanner()
    taken = []
    for size in (1 << 18, 1 << 20):
        began = time.process_time()
        scanner.spans([(unit * (size // len(unit))).encode()])
        taken.append(time.process_time() - began)
    assert taken[1] < 5 and taken[1] < 10 * max(taken[0], 0.05)


def test_jwt_needs_a_left_boundary():
    scanner = secret_scan.TrigramScanner()
    token = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
    found = [secret_scan.RULES[k].kind for _, k, _ in scanner.spans([f"x {token} y".encode()])[0]]
    assert "jwt" in found
    assert "jwt" not in [secret_scan.RULES[k].kind for _, k, _ in scanner.spans([f"x{token}"[:14].encode()])[0]]


def test_more_languages_than_a_word_has_bits():
    grams = {f"l{i:03d}": np.arange(1000 * i, 1000 * i + 200, dtype=np.uint64) for i in range(130)}
    model = language_id.LanguageModel.build(grams, 4, 1 << 17, 3)
    masks = model.masks(grams["l128"])
    assert masks.shape[1] == 3 and (masks[:, 2] & np.uint64(1)).all()
    words = {f"{chr(97 + i // 26)}{chr(97 + i % 26)}": f"{chr(97 + i // 26)}{chr(97 + i % 26)}q{chr(97 + i % 26)}zx " * 9 for i in range(100)}
    model = language_id.LanguageModel.build({k: np.unique(language_id.text_grams(w.encode(), 4)) for k, w in words.items()}, 4, 1 << 17, 3)
    assert [x for x, _ in model.predict([w.encode() for w in words.values()])] == list(words)


def test_parts_of_a_long_text_count_like_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    text = bytes(rng.choice(np.frombuffer(b"abcde fgh", np.uint8), 1000))
    model = language_id.LanguageModel.build({"x": np.unique(language_id.text_grams(text[:300], 4)), "y": np.unique(language_id.text_grams(text[300:500], 4))}, 4, 1 << 12, 3)
    texts = [text[:n] for n in (1, 2, 3, 4, 5, 63, 64, 65, 66, 67, 128, 997, 1000)]
    whole = model.predict(texts)
    monkeypatch.setattr(language_id, "PART", 16)
    assert model.predict(texts) == whole


def test_trigram_queries():
    assert secret_scan.trigram_query(r"[0-9a-f]+") is True
    assert secret_scan.trigram_query(r"a?b?") is True
    assert secret_scan.trigram_query("ABCD") == ("and", (("tri", b"abc"), ("tri", b"bcd")))
    assert secret_scan.trigram_query("(?:foo|barn)[0-9]+") in (
        ("or", (("tri", b"foo"), ("and", (("tri", b"bar"), ("tri", b"arn"))))), ("or", (("and", (("tri", b"bar"), ("tri", b"arn"))), ("tri", b"foo"))),
    )
    assert secret_scan.trigram_query("(?:abc|x)y*") is True


def test_patience_alignment():
    a, b = "a b c d e f".split(), "x a b q c d y f".split()
    pairs = license_scan.patience(a, b)
    assert [a[i] for i, _ in pairs] == [b[j] for _, j in pairs] == ["a", "b", "c", "d", "f"]
    assert license_scan.increasing([5, 1, 2, 9, 3, 4]) == [1, 2, 4, 5]
    assert license_scan.patience([], b) == [] and license_scan.increasing([]) == []
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(20))] for _ in range(2))
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_licenses(spark, odd_docs, no_docs):
    mit = license_scan.TEMPLATES["MIT-text"].split()
    changed = " ".join(mit[:10] + ["inserted", "here"] + mit[10:40] + mit[42:])
    texts = ["filler words " * 40 + changed + " tail" * 50, "Licensed under the Apache License, Version 2.0.", "licensed to kill under version 2.0", "All rights reserved. Foo. All rights reserved.", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: {x["license"] for x in r["licenses"]} for r in license_scan.scan(docs).collect()}
    assert out == {0: {"MIT-text"}, 1: {"Apache-2.0"}, 2: set(), 3: {"Proprietary"}, 4: set(), 5: set()}
    assert [len(r["licenses"]) for r in license_scan.scan(docs.where("doc_id = 3")).collect()] == [2]
    assert license_scan.scan(odd_docs).count() == odd_docs.count() and license_scan.scan(no_docs).count() == 0


ITEM = "Anna has 12 apples and gives 3 apples to Bob. How many apples does Anna have after 12 days?"


@pytest.mark.parametrize("name", ["MIT", "GPL-3.0", "MIT-text", "Apache-2.0-notice", "BSD-2-Clause", "BSD-3-Clause"])
def test_every_adjacent_copy_of_a_license_is_found(name):
    scanner = license_scan.LicenseScanner(license_scan.TEMPLATES, 0.8)
    text = license_scan.TEMPLATES[name]
    for n in (1, 2, 3, 4, 6, 10, 50):
        for before, after in (("", ""), ("some prose goes before. ", " and some prose after it")):
            found = [x[0] for x in scanner.scan(before + " ".join([text] * n) + after)]
            assert found.count(name) == n
            assert not name.startswith("BSD-") or len({x for x in found if x.endswith("-Clause")}) == 1


def test_licenses_equal_a_scan_of_all_windows():
    """Brute force: some window of the text covers enough of the template by longest common
    subsequence wherever a license is reported, and none does where nothing is."""
    rng = random.Random(8)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    names = ("MIT", "CC-BY-4.0", "GPL-3.0", "CC0-1.0", "Unlicense")
    templates = {n: license_scan.TEMPLATES[n] for n in names}
    scanner = license_scan.LicenseScanner(templates, 0.8)
    vocabulary = "the of and a work license under this software public general free".split()
    for _ in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        inserted = license_scan.words_of(templates[rng.choice(names)])
        for _ in range(rng.randrange(4)):  # changed, lost and added words
            at = rng.randrange(len(inserted))
            inserted[at : at + 1] = rng.choice([[], ["other"], [inserted[at], "more"]])
        at = rng.randrange(len(words) + 1)
        words[at:at] = inserted
        found = {x[0] for x in scanner.scan(" ".join(words))}
        for name, template in templates.items():
            template = license_scan.words_of(template)
            best = max(common(template, words[i : i + 2 * len(template) + 8]) for i in range(max(1, len(words))))
            if name in found:
                assert best >= 0.8 * len(template)
            elif best < len(template):
                continue
            else:  # a whole copy without other words in it is always found
                assert f" {' '.join(template)} " not in f" {' '.join(words)} "


def test_decontamination(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "too short", 0), (4, ITEM, 0), (5, "", 0), (None, "nobody ever wrote these particular seven words here", 0)], "item_id long, text string, doc_id int")
    texts = [
        "Before. " + ITEM + " After.", "Clara has 15 apples and gives 4 apples to Dave. How many apples does Clara have after 15 days?",
        "Clara has 15 apples and gives 4 apples to Dave. Nothing else to see in this text.", "a wholly different text " * 20, None, "", "too short", ITEM.upper(),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, matches string")
    out = {r["doc_id"]: {m["item_id"]: m for m in r["matches"]} for r in decontaminate.find(docs, benchmark).collect()}
    assert set(out) >= {0, 1} and set(out[0]) == {1, 4} and not set(out) & {3, 4, 5, 6}
    assert out[1][1]["changed_slots"] >= 3 and out[0][1]["changed_slots"] == 0
    inconsistent = decontaminate.BenchmarkIndex([(1, ITEM)], 8, 4)
    reader = decontaminate.TemplateReader()
    good = inconsistent.matches(*reader.read(texts[1].encode()), 0.9)
    bad = inconsistent.matches(*reader.read(texts[1].replace("after 15", "after 99").replace("does Clara", "does Eve").encode()), 0.9)
    assert good and not bad
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(8)) - set(out)
    assert decontaminate.find(odd_docs, benchmark).count() == 0 and decontaminate.clean(odd_docs, benchmark).count() == odd_docs.count()
    assert decontaminate.find(odd_docs, benchmark.limit(0)).count() == 0 and decontaminate.find(no_docs, benchmark).count() == 0
    several = decontaminate.find(docs, benchmark, block_items=2)
    assert {r["doc_id"] for r in several.collect()} == set(out)


def matches(item, text, least_cover=0.5):
    index = decontaminate.BenchmarkIndex([(1, item)], 8, 4)
    return index.matches(*decontaminate.TemplateReader().read(text.encode()), least_cover)


def test_decontamination_finds_copies_in_any_case():
    item = "The guide Anna from Dora met Bob near Lake Orta and asked Carl how far Rome was from Paris."
    for text in (item.upper(), item.lower(), item.title(), "before " + ITEM.upper() + " after"):
        assert matches(ITEM if "APPLES" in text else item, text, 0.9)
    assert matches(ITEM, ITEM.upper().replace("12", "15"), 0.9)


def test_licenses_that_follow_each_other():
    scanner = license_scan.LicenseScanner(license_scan.TEMPLATES, 0.8)
    for name in ("MIT", "MIT-text", "Apache-2.0-notice", "GPL-3.0"):
        copy = license_scan.TEMPLATES[name].split()
        for copies in (2, 3, 4, 7):
            for between in ([], ["word"], ["some", "more", "words"]):
                words, places = "one two three four five six".split(), []
                for _ in range(copies):
                    places.append((len(words), len(words) + len(copy) - 1))
                    words += copy + between
                found = scanner.scan(" ".join([*words, *"six seven eight nine ten eleven".split()]))
                assert [x[4:6] for x in found if x[0] == name] == places, (name, copies, between)


def test_decontamination_finds_short_items():
    items = [(1, "What is 12 times 7?"), (2, "Compute 3 plus 9."), (3, "12 + 7 = ?"), (4, "too short")]
    index, reader = decontaminate.BenchmarkIndex(items, 8, 4), decontaminate.TemplateReader()
    found = lambda text: {x[0] for x in index.matches(*reader.read(text.encode()), 0.5)}
    assert found("As they say: what is 12 times 7? Nobody knew.") == {1}
    assert found("Compute 3 plus 9.") == {2} and found("now COMPUTE 3 plus 9, please") == {2}
    assert found("so 12 + 7 = ? was asked") == {3}
    assert found("this is too short") == set() and found("compute 3 plus 10 or 12 7 or what is 12") == set()


def test_decontamination_types_names_that_start_a_sentence_and_number_words():
    item = "Maria buys three apples and gives two of them to a friend who waits outside. How many does Maria keep for her own lunch?"
    index, reader = decontaminate.BenchmarkIndex([(1, item)], 8, 4), decontaminate.TemplateReader()
    (match,) = index.matches(*reader.read(item.replace("Maria", "Pedro").replace("three", "nine").replace("two", "4").encode()), 0.5)
    assert match[2] == match[3] and match[5] == 3
    spoilt = item.replace("Maria buys", "Pedro buys")  # two names stand for one
    assert all(x[2] < x[3] for x in index.matches(*reader.read(spoilt.encode()), 0.3))


def test_decontamination_finds_items_of_numbers_and_units():
    item = "3 kg 17 m 4 s 12 kg 99 m 5 s 8 kg 41 m 7 s sum 250"
    assert matches(item, f"before {item} after", 1.0)[0][4] == matches(item, item)[0][4] > 0
    assert matches("12 4 9 31 5 88", "x 12 4 9 31 5 88 y", 1.0)
    assert not matches(item, item.replace("17", "18").replace("99", "98").replace("41", "40"))


def test_decontamination_adds_up_neighbouring_diagonals():
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    item = " ".join(words)
    longer = " ".join(words[:13] + ["put"] + words[13:27] + ["in", "here"] + words[27:])
    assert matches(item, "before " + longer + " after")[0][1:4] == (1, 40, 40)
    named = " ".join(words[:13] + ["Anna"] + words[13:27] + ["Bob"] + words[27:])
    assert matches(named, named.replace("Anna", "Mary Jane").replace("Bob", "John van Dyke".title()), 0.9)
    assert matches(named, named.replace("Anna", "3 kg").replace("Bob", "12"))
    assert not matches(item, " ".join(words[27:] + ["x"] + words[13:27] + ["x"] + words[:13]))
    assert not matches(item, " ".join(words[:13] + ["x"] * 60 + words[13:19]))
