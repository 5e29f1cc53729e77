"""Operators that compare rows: 4, 7, 8 and 10, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, line_dedup, ngram_join, similarity, vector_join, warc


def test_components_against_local_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (1000, 1001)]
    union = common.LocalUnionFind(2000)
    for a, b in edges:
        union.union(a, b)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    out = common.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["id"]: r["component_id"] for r in out} == {x: union.find(x) for x in touched}
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    x = np.concatenate([x, x[:60] * 1.5 + rng.normal(size=(60, 8)) * 0.15, x[:20], x[:20]])
    rows = [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, 3, len(x)), strict=True))]
    odd = [None, [], [0.0] * 8, [1.0, float("nan")] + [0.0] * 6, [float("inf")] + [1.0] * 7, [1.0, None] + [0.0] * 6, [1.0, 0.0], [-0.0] * 8, [1e200] * 8, [1e-200] * 8]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(2000, rows[0][1], None)]
    return rows


@pytest.mark.parametrize("options", [{}, {"cell_rows": 20, "block_rows": 16}, {"cell_rows": 8, "block_rows": 1000}])
def test_vector_join(spark, options):
    rows = vectors()
    expected = vector_join.brute_force([r[0] for r in rows if r[0] not in (1008, 1009)], [r[1] for r in rows if r[0] not in (1008, 1009)], [r[2] for r in rows if r[0] not in (1008, 1009)], 0.9)
    df = spark.createDataFrame([(*r, "x") for r in rows if r[0] not in (1008, 1009)], "vec_id long, embedding array<double>, label int, rep string")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_join.range_join(df, threshold=0.9, **options).collect()}
    assert out == expected and sum(n for n, _ in out.values()) > 60


def test_vector_join_of_extreme_sizes_and_nothing(spark):
    df = spark.createDataFrame([(1, [1e200] * 4, 0), (2, [1e-200] * 4, 0), (3, [-1.0] * 4, 0)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_join.range_join(df).collect()} == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}
    assert vector_join.range_join(df.limit(0)).count() == 0


def copies(seed, k_words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(k_words)]
    texts, i = {}, 0
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 30, 80]))]
        for _ in range(rng.choice([1, 3, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[i] = (" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words)) or None
            i += 1
    return texts | {i: None, i + 1: "", i + 2: "  \n", i + 3: "Ä b c", i + 4: "ä b c", i + 5: "long " * 20_000}


def test_ngram_join(spark, odd_docs, no_docs):
    texts = copies(2)
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in texts.items()], "doc_id long, text string, id int, comp string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()}
    assert out == ngram_join.brute_force(texts)
    rows = ngram_join.join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[25] == found[1] == 1 and found[20] == 20 and found[21] == 21
    assert ngram_join.join(no_docs).count() == 0


def test_signature_trees_lose_no_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64)
        for _ in range(rng.integers(1, 5)):
            keep = base[rng.random(len(base)) < rng.choice([0.8, 0.95, 1.0])]
            sets.append(np.unique(np.concatenate((keep, rng.integers(0, 1 << 62, rng.integers(0, 4)).astype(np.uint64)))))
    wanted = {(i, j) for i in range(len(sets)) for j in range(i) if similarity.similar(sets[i], sets[j], 80)}
    assert len(wanted) > 20
    for bits in (64, 256):
        tree = similarity.SignatureTree(sets, bits, fan=3)
        found = [(max(a, b), min(a, b)) for x, y in tree.candidates(tree, 80) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert wanted <= set(found) and len(found) == len(set(found))
        left, right = similarity.SignatureTree(sets[:50], bits), similarity.SignatureTree(sets[50:], bits, fan=8)
        crossed = {(b + 50, a) for x, y in left.candidates(right, 80) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        assert {(i, j) for i, j in wanted if i >= 50 > j} <= crossed


@pytest.mark.parametrize("block_rows", [7, 512])
def test_whole_cells_are_exact(spark, block_rows):
    texts = copies(8)
    hashes = common.WordHashes()
    sets = {i: common.shingle_set((t or "").encode().lower().split(), 5, hashes) for i, t in texts.items()}
    items = spark.createDataFrame([(i, s.astype("<u8").tobytes()) for i, s in sets.items() if len(s)], "id long, tokens binary")
    cells = items.select(F.lit(1).cast("long").alias("key"), "id", F.col("id").alias("comp"))
    cells = similarity.merged_cells(cells.union(cells.withColumn("key", F.lit(2).cast("long"))), most=10 if block_rows == 7 else 2048)
    found = common.components(similarity.cell_links(cells, items, 80, whole=True, block_rows=block_rows))
    expected = {i: c for i, (_, c) in ngram_join.brute_force(texts).items() if i != c}
    assert {r["id"]: r["component_id"] for r in found.collect() if r["id"] != r["component_id"]} == expected


def line_texts():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    bases = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 8, 20, 60, 200]))) for _ in range(50)]
    texts = {}
    for i in range(80):
        lines = []
        for _ in range(rng.choice([1, 2, 4])):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(letters)
            lines.append("".join(line).upper() if rng.random() < 0.1 else "".join(line))
        texts[i] = "\n".join(lines)
    return texts | {90: None, 91: "", 92: "\n \n", 93: "é" * 30_000, 94: texts[3], 95: "x\n\nunique line of text here"}


def test_line_dedup(spark, odd_docs, no_docs):
    texts = line_texts()
    df = spark.createDataFrame([(k, v, "src", None if v is None else len(v), 7) for k, v in texts.items()], "doc_id long, text string, source string, n_chars long, keeper int")
    expected = line_dedup.brute_force(texts)
    out = line_dedup.find_lines(df).collect()
    assert {(r["doc_id"], r["line_no"]): (r["keeper_doc_id"], r["keeper_line_no"]) for r in out} == expected
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["keeper_doc_id"], r["keeper_line_no"])) for r in out)
    left = {}
    for d, text in texts.items():
        lines = (text or "").split("\n")
        stay = [x for i, x in enumerate(lines) if expected.get((d, i), (d, i)) == (d, i)]
        if len(stay) == len(lines) or any(x.strip() for x in stay):
            left[d] = None if text is None else "\n".join(stay)
    cleaned = line_dedup.dedup(df)
    assert cleaned.columns == df.columns and cleaned.dtypes == df.dtypes
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()} == {d: (t, None if t is None else len(t)) for d, t in left.items()}
    assert line_dedup.find_lines(no_docs).count() == 0 and line_dedup.dedup(no_docs).count() == 0
    odd = line_dedup.dedup(odd_docs)
    assert odd.columns == odd_docs.columns and 25 not in {r["doc_id"] for r in odd.select("doc_id").collect()}


def test_lines_of_72_characters_with_one_edit_link(spark):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(72))
    other = line[:36] + "#" + line[37:]
    docs = spark.createDataFrame([(1, line), (2, other)], "doc_id long, text string")
    assert [r["keeper_doc_id"] for r in line_dedup.find_lines(docs).collect()] == [1, 1]
    assert set(line_dedup.brute_force({1: line, 2: other}).values()) == {(1, 0)}


@pytest.mark.parametrize("size", [20, 80, 110, 150, 170, 400])
def test_band_keys_meet_at_the_threshold(size):
    rng, hit, total = random.Random(size), 0, 0
    while total < 60:
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size))
        other = list(line)
        for _ in range(max(1, size // 100)):
            other[rng.randrange(size)] = "#"
        other = "".join(other) + line[: rng.choice([0, 2])]
        if similarity.similar(line_dedup.char_set(line, 8), line_dedup.char_set(other, 8), 80):
            keys, owners = line_dedup.band_keys([line, other], 8, 16, 4)
            total += 1
            hit += len(set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())) > 0
        elif size == 20:
            total += 1
            hit += 1
    assert hit >= 59


PAGES = [(1, "http://a/ b\r\n", "<p>x</p>"), (2, None, None), (3, "http://c", "<p>x</p>"), (4, "http://d", ""), (5, "http://é", "ü" * 9000), (6, "http://f", "<p>x</p>"), (7, "u", "WARC/1.1\r\n\r\n\x1f")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    out = warc.read(warc.write(pages, archive_bytes=300)).collect()
    assert {r["kind"] for r in out} == {"record"}
    out = {r["page_id"]: r for r in out}
    for page_id, _, html in PAGES:
        payload, r = (html or "").encode(), out[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), warc.base32_sha1(payload))
        assert r["refers_to"] == {1: 6, 3: 6, 2: 4}.get(page_id) and r["record_type"] == ("revisit" if r["refers_to"] else "response")
        assert r["payload"] is None if r["refers_to"] else bytes(r["payload"]) == payload
    least = {r["page_id"]: r["refers_to"] for r in warc.read(warc.write(pages, least_bytes=1)).collect()}
    assert least[2] is None and least[1] == 6
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    twice = pages.where("page_id = 6").union(pages.where("page_id = 6")).union(pages.where("page_id = 1")).union(pages.selectExpr("cast(null as long)", "url", "html", "digest").where("html = ''"))
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in warc.read(warc.write(twice)).collect()) == [(0, "response"), (1, "revisit"), (6, "response"), (6, "response")]


def archive(packed):
    records = [warc.record_bytes(i, f"http://x/{i}", b"payload %d " % i * 40, None, "2024-01-01T00:00:00Z") for i in range(8)]
    return [warc.gzip_member(r) if packed else r for r in records]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_is_valid(packed):
    parts = archive(packed)
    whole = b"".join(parts)
    pages = lambda data: [x.headers["warc-record-id"] for x in warc.salvage(data) if isinstance(x, warc.Record)]
    ids = [warc.page_urn(i) for i in range(8)]
    assert pages(whole) == ids and not any(isinstance(x, warc.Gap) for x in warc.salvage(whole))
    start = len(parts[0]) + len(parts[1])
    spoilt = bytearray(whole)
    spoilt[start + len(parts[2]) // 2] ^= 0x55
    gaps = [x for x in warc.salvage(bytes(spoilt)) if isinstance(x, warc.Gap)]
    assert pages(bytes(spoilt)) == ids[:2] + ids[3:] and [(g.offset, g.length) for g in gaps] == [(start, len(parts[2]))]
    cut = b"".join(parts[:3])[:-20] + b"".join(parts[3:])
    assert pages(cut) == ids[:2] + ids[3:]
    assert pages(whole[: -len(parts[7]) // 2]) == ids[:7]
    assert pages(b"junk \x1f\x8b\x08 WARC/1.0 junk" + whole) == ids
    assert pages(b"") == [] and [type(x) for x in warc.salvage(b"only junk")] == [warc.Gap]


def test_salvage_inside_a_member():
    plain = archive(False)
    ids = [warc.page_urn(i) for i in range(8)]
    pages = lambda data: [x.headers["warc-record-id"] for x in warc.salvage(data) if isinstance(x, warc.Record)]
    spoilt = bytearray(b"".join(plain))
    spoilt[len(plain[0]) + len(plain[1]) // 2] ^= 0x55
    member = warc.gzip_member(bytes(spoilt))
    found = list(warc.salvage(member + warc.gzip_member(plain[0])))
    assert pages(member + warc.gzip_member(plain[0])) == [ids[0], *ids[2:], ids[0]]
    assert [(g.plain_offset, g.plain_length) for g in found if isinstance(g, warc.Gap)] == [(len(plain[0]), len(plain[1]))]
    whole = warc.gzip_member(b"".join(plain))
    assert pages(whole) == ids
    assert pages(whole[:-30]) == ids[:7] or pages(whole[:-30]) == ids
    assert pages(whole[:-30] + whole) == pages(whole[:-30]) + ids  # cut short, and another member follows
    stored = bytearray(warc.gzip_member(b"".join(plain), 0))  # not compressed: damage stays where it is
    stored[stored.index(b"payload 3 payload 3") + 40] ^= 0x55
    assert pages(bytes(stored)) == ids[:3] + ids[4:]
    assert any(isinstance(x, warc.Gap) for x in warc.salvage(bytes(stored)))
    without = b"".join(re.sub(rb"WARC-(Block|Payload)-Digest: [^\r]*\r\n", b"", r) for r in plain)
    assert pages(warc.gzip_member(without)) == ids and pages(warc.gzip_member(without)[:-3]) == []


def test_components_over_several_tasks(spark, monkeypatch):
    """Edges that do not fit one task need the distributed steps."""
    monkeypatch.setattr(common, "TASK_EDGES", 16)
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 50)] + [tuple(x) for x in rng.integers(2000, 2040, (40, 2)).tolist()]
    found = {r["id"]: r["component_id"] for r in common.components(spark.createDataFrame(chain, "src long, dst long").repartition(7)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in chain:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for e in chain if e[0] != e[1] for x in e}
    assert found == {x: find(x) for x in linked}


def test_line_dedup_keeps_unique_lines_of_rows_without_doc_id(spark):
    shared = "a line that all of these documents have in common, word for word"
    rows = [
        (1, f"{shared}\nunique line of document one"), (None, f"unique line of document A that must stay\n{shared}"),
        (None, f"{shared}\nunique closing line of B"), (7, f"{shared}\nunique words of copy A only"), (7, f"unique words of copy B\n{shared}"),
    ]
    out = {r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept_lines = [x for t in out for x in t.split("\n")]
    for line in ("document one", "document A", "closing line of B", "copy A only", "copy B"):
        assert sum(line in x for x in kept_lines) == 1
    assert 1 <= kept_lines.count(shared) <= 2


def test_vectors_that_share_an_id(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.999, 0.01]
    rows = [(5, a, 1), (5, b, 1), (7, c, 1), (9, a, 1), (5, a, 2), (None, b, 1)]
    out = vector_join.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)
    assert found == sorted([(5, 1, 5), (5, 2, 5), (7, 2, 5), (9, 1, 5), (5, 0, 5), (None, 2, 5)], key=str)


def test_default_pivots_equal_brute_force(spark):
    """Pivots are in use at default parameters, replicate, prune, and lose no link."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * (0.04 if i % 3 else 0.6)).tolist(), i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_join.range_join(df).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([x for *_, x in rows])
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    assert [out[i][0] for i in range(900)] == linked.sum(axis=1).tolist()
    report = vector_join.cell_report(df).collect()
    assert len(report) > 4 and sum(r["homes"] for r in report) == 900 and sum(r["guests"] for r in report) > 0
    assert sum(r["compared"] for r in report) < 0.8 * 2 * (450 * 449 // 2)
