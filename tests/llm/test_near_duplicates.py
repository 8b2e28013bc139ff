"""Operators on pairs against brute force over all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from meridian.llm import _links, _shared, ngram_jaccard_join, queries, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def word_set(text, k=5):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def brute(rows):
    sets = [(i, word_set(t)) for i, t in rows]
    pairs = [(x, y) for x in range(len(sets)) for y in range(x) if sets[x][1] and 5 * len(sets[x][1] & sets[y][1]) >= 4 * len(sets[x][1] | sets[y][1])]
    found = classes_of(pairs, range(len(sets)))
    least = defaultdict(list)
    for n, r in found.items():
        if sets[n][0] is not None:
            least[r].append(sets[n][0])
    return Counter((i, len(s), min(least[found[n]], default=None)) for n, (i, s) in enumerate(sets))


def planted(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklm") + str(rng.randrange(400))
    common = [word() for _ in range(30)]
    texts = []
    for _ in range(8):
        body = [word() for _ in range(rng.choice([3, 5, 8, 40, 150]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(body)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([*common, *(word() for _ in range(rng.randrange(2, 25)))]) for _ in range(40)]
    base = [word() for _ in range(100)]
    for _ in range(60):  # a chain: each differs a little from the one before
        base = list(base)
        base[rng.randrange(100)] = word()
        texts.append(" ".join(base))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(params=["documents", "odd", "none", "planted"])
def docs(request, spark):
    if request.param == "planted":
        return spark.createDataFrame(planted(), "doc_id long, text string").repartition(3)
    return request.getfixturevalue(request.param)


def test_ngram_jaccard(docs):
    got = ngram_jaccard_join.near_duplicates(docs)
    assert Counter(tuple(r) for r in got.collect()) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_one_row_of_each_class(spark):
    rows = [(1, "a", 1), (5, "a", 2), (5, "b", 3), (7, "c", 4), (7, "c", 4), (None, "a", 5), (None, "a", 5), (8, None, 6), (8, None, 6), (None, "", 7), (None, "d", 8), (None, "d", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th long").repartition(3)
    got = ngram_jaccard_join.without_near_duplicates(docs)
    assert got.columns == docs.columns
    left = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert left == Counter({(1, "a"): 1, (5, "b"): 1, (7, "c"): 1, (8, None): 2, (None, ""): 1, (None, "d"): 1})


def test_words_that_polynomials_confuse(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word + "a"), (4, word.upper()), (5, "x " * 5 + word * 100), (6, "x " * 5 + other * 100)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 6}


def test_ngram_jaccard_with_frequent_shingles_last(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard_join, "COUNT_LEAST", 2)
    monkeypatch.setattr(ngram_jaccard_join, "FREQUENT_LEAST", 3)
    docs = spark.createDataFrame(planted(5), "doc_id long, text string")
    assert Counter(tuple(r) for r in ngram_jaccard_join.near_duplicates(docs).collect()) == brute(planted(5))


@pytest.mark.parametrize("batch", [1, 2, 3, 1000])
def test_tiles_over_batches(spark, batch):
    rng = random.Random(batch)
    rows = [(rng.randrange(12), i, 10 + i % 7 * 4) for i in range(60)] + [(99, 7, 5), (98, 8, 5), (98, 8, 5)]
    rows += rows[:20]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = _links.tiles(spark.createDataFrame(rows, "key long, id long, size int"), 80, prune=False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(set)
    for k, i, s in rows:
        groups[k].add((s, i))
    want = set()
    for k, members in groups.items():
        if len(members) > 1:
            lead, least = {}, min(members)[0]
            for s, i in sorted(members):
                band = int(np.floor(np.log(s / least) / np.log(1.25) + 1e-9))
                want.add((k, i, s, lead.setdefault(band, i)))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pruned_rows_have_no_partner():
    rng = np.random.default_rng(5)
    for _ in range(200):
        of = np.sort(rng.integers(0, 6, 30))
        size = rng.integers(5, 60, 30)
        order = np.lexsort((size, of))
        of, size = of[order], size[order]
        left = np.maximum(1, size - rng.integers(0, 12, 30))
        want = [any(x != y and of[x] == of[y] and 180 * min(left[x], left[y]) >= 80 * (size[x] + size[y]) for y in range(30)) for x in range(30)]
        got = _links.partnered(of, size, left, 80)
        assert all(g == w for g, w, n in zip(got, want, np.bincount(of)[of], strict=True) if n <= _links.SMALL_TILE)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(50)]
    got = _links.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert {r["id"]: r["root"] for r in got} == classes_of([p for p in pairs if p[0] != p[1]], nodes) and len(got) == len(nodes)


def test_bitmaps_never_refuse_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64))))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 80 * (len(a) + len(b) - inter):
            bits = [np.frombuffer(_links.bitmap(x), np.uint64)[None] for x in (a, b)]
            words = min(x.shape[1] for x in bits)
            assert _links.overlap_possible(*(_links.folded(x, words) for x in bits), np.array([len(a)]), np.array([len(b)]), 80).all()


def brute_repeats(rows, min_words):
    found = [
        (i, p, s, s + len(line), word_set(line))
        for i, t in rows if t is not None
        for p, (s, line) in enumerate(zip(np.cumsum([0, *(len(x) + 1 for x in t.split("\n"))]).tolist(), t.split("\n")))
        if len(re.findall("[^\x20\x09-\x0d]+", line)) >= min_words
    ]
    pairs = [(x, y) for x in range(len(found)) for y in range(x) if 5 * len(found[x][4] & found[y][4]) >= 4 * len(found[x][4] | found[y][4])]
    groups = defaultdict(list)
    for n, r in classes_of(pairs, range(len(found))).items():
        groups[r].append(found[n][:4])
    out = Counter()
    for g in groups.values():
        if len(g) > 1:
            first = min(g, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            for i, p, s, e in g:
                out[i, p, s, e, first[0], first[1], len(g), (i, p, s) != first[:3]] += 1
    return out


def test_substring_dedup(docs):
    got = substring_dedup.repeats(docs, min_words=6)
    assert Counter(tuple(r) for r in got.drop("text_hash").collect()) == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], 6)


def test_substring_removal(spark):
    line = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"é a\n{line}\nb", 5), (2, f"c\n{line.upper()}", 6), (3, None, 7), (4, f"{line}\n{line}", 8)], "doc_id long, text string, first long")
    left = substring_dedup.without_repeats(docs, substring_dedup.repeats(docs))
    assert sorted(map(tuple, left.collect())) == [(1, f"é a\n{line}\nb", 5), (2, "c", 6), (3, None, 7), (4, "", 8)]


def test_removal_goes_by_id_and_text(spark):
    """Texts of one id aren't mixed up; of rows that are equal in id and text, or in text alone, one keeps its text."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (7, c, 4), (7, c, 4), (8, f"x\n{d}", 5), (8, f"y\n{d}", 6), (9, None, 7), (9, None, 7), (None, "one two", 8), (None, "one two", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th long").repartition(3)
    for remove, find in ((substring_dedup.without_repeats, substring_dedup.repeats), (substring_dedup.without_passages, substring_dedup.passages)):
        got = remove(docs, find(docs))
        assert got.columns == docs.columns
        left = Counter((r["doc_id"], r["text"] and r["text"].strip()) for r in got.collect())
        assert [left[k] for k in ((1, a), (5, ""), (5, b), (7, c), (7, ""), (9, None), (None, "one two"))] == [1, 1, 1, 1, 1, 2, 2]
        assert sorted(t for (i, t), _ in left.items() if i == 8) in (["x", f"y\n{d}"], [f"x\n{d}", "y"]) and left.total() == len(rows)
    first = spark.createDataFrame([(None, a), (1, a), (1, "z")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[1]) for r in substring_dedup.without_repeats(first, substring_dedup.repeats(first)).collect()) == [(0, a), (1, ""), (1, "z")]


def brute_passages(rows, least=50):
    """(id, start, end) of every word that stands in a repeated window, and whether an occurrence before it holds it."""
    places, out = defaultdict(list), {}
    for i, t in rows:
        words = [(m.start(), m.end(), m[0].translate(LOWER)) for m in re.finditer("[^\x20\x09-\x0d]+", t or "")]
        for k in range(len(words) - least + 1):
            window = words[k : k + least]
            found = places[tuple(w for *_, w in window)]
            if not found or found[-1][0] != i or found[-1][1] + least <= k:
                found.append((i, k, window))
    for found in places.values():
        if len(found) > 1:
            for n, (i, _, window) in enumerate(found):
                for s, e, _ in window:
                    out[i, s, e] = out.get((i, s, e), False) or n > 0
    return out


def check_passages(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want, texts = brute_passages(rows), dict(rows)
    got, removed = set(), set()
    for r in substring_dedup.passages(docs).collect():
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        assert part == part.strip() and r["n_occurrences"] > 1 and r["paragraph"] == texts[r["doc_id"]][: r["start"]].count("\n")
        for m in re.finditer("[^\x20\x09-\x0d]+", part):
            place = r["doc_id"], r["start"] + m.start(), r["start"] + m.end()
            got.add(place)
            if r["removed"]:
                removed.add(place)
    assert got == set(want) and removed == {p for p, again in want.items() if again}
    return len(want)


def test_passages_in_longer_lines_and_over_short_lines(spark):
    word = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    shared, common = word("Éa", 60), word("c", 30)
    texts = [
        " ".join([*word("p", 300), *shared, *word("q", 300)]),
        "x y\n" + "\n".join(" ".join(shared[i : i + 7]).upper() for i in range(0, 60, 7)),
        " ".join([*word("r", 10), *shared[5:54], *word("s", 10)]),  # 49 words
        " ".join([*word("t", 40), *common]), " ".join([*word("u", 40), *common, *shared[:50]]), "z " * 200, None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert check_passages(docs) > 60 * 2 + 50
    left = dict(map(tuple, substring_dedup.without_passages(docs, substring_dedup.passages(docs)).collect()))
    assert left[0] == texts[0] and left[1].split() == ["x", "y"] and left[2] == texts[2] and left[4].split() == [*word("u", 40), *common] and left[6] is None


def test_passages_of_documents(documents):
    assert check_passages(documents.where("text is not null").dropDuplicates(["doc_id"]))


def test_query_has_passages(spark, tmp_path):
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(i, " ".join(f"{i}v{j}" for j in range(200)) + " " + shared) for i in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["removed"], rows[r["doc_id"]][1][r["start"] : r["end"]]) for r in queries.op10_substring_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(0, False, shared), (1, True, shared)]


def test_bands():
    assert 1 - (1 - 0.8**4) ** substring_dedup.bands_for(80, 0.999) >= 0.999


def test_word_hashes_do_not_depend_on_place_or_pieces(monkeypatch):
    texts = [b"One two\tONE\n\x0bthree", None, b"", b" ", b"x" * 5000 + b" one " + b"X" * 5000, "é ü".encode()] * 3
    hashes, starts, offsets, whole = _shared.hashed_words(texts)
    words = whole.lower().split()
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words)) == len(set(zip(hashes.tolist(), words, strict=True)))
    assert [whole[s : s + len(w)].lower() for s, w in zip(starts.tolist(), words, strict=True)] == words
    monkeypatch.setattr(_shared, "HASH_BYTES", 64)
    again = _shared.hashed_words(texts)
    assert (again[0] == hashes).all() and (again[1] == starts).all() and (again[2] == offsets).all()
