"""Suffix dedup, Jaccard join, language ID and decontamination against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from awkward import EXTRA, SCHEMA, empty, messy, rows_of_documents, words  # noqa: F401
from corpuslens.llm import decontaminate, jaccard_join, language_id, suffix_dedup
from corpuslens.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_repeats(docs):
    """doc -> (bytes, removed, runs, digest) for (doc_id, text) in order."""
    seen, out = set(), []
    for doc_id, text in docs:
        b = (text or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                mark[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        runs = sum(m and not mark[i - 1] if i else m for i, m in enumerate(mark))
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((doc_id, len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def removed(df):
    return Counter(tuple(r) for r in df.drop("kept").collect())


def test_repeated_strings(spark):
    pick = random.Random(5)
    shared = [words(100 + i, 30) for i in range(5)]
    docs = [(i, f"{words(i, pick.randint(1, 40))} {pick.choice(shared)} {words(500 + i, 10)}") for i in range(60)]
    for period in (1, 2, 31, 67, 68, 69, 70, 71, 99, 100, 101, 150):  # texts that repeat themselves
        docs.append((200 + period, (words(period, 60)[:period] * 400)[:600]))
    docs += [(400, None), (401, ""), (402, "x" * 99), (403, "y" * 100), (404, "é" * 3000), (405, words(405, 4000)), (406, words(405, 4000)[7:])]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, key string").repartition(5)
    assert removed(suffix_dedup.without_repeats(frame)) == Counter(plain_repeats(docs))
    assert suffix_dedup.without_repeats(frame.limit(0)).count() == 0


def test_hot_anchors_and_small_limits(spark, monkeypatch):
    shared = words(9, 40)
    docs = [(i, f"{words(i, 12)} {shared} {words(1000 + i, 12)}") for i in range(300)]
    monkeypatch.setattr(suffix_dedup, "HOT_SPANS", 20)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 1 << 40)
    monkeypatch.setattr(suffix_dedup, "LOCAL_SPANS", 3)
    monkeypatch.setattr(suffix_dedup, "BUFFER_BYTES", 500)  # long texts in slices
    docs += [(500, words(500, 1500)), (501, words(501, 20) + words(500, 1500)), (502, "ab" * 2000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    assert removed(suffix_dedup.without_repeats(frame)) == Counter(plain_repeats(docs))


def test_repeats_of_messy_documents(messy):
    got = removed(suffix_dedup.without_repeats(messy))
    assert sum(got.values()) == len(rows_of_documents())
    by_id = {r[0]: r for r in got if r[0] not in (None, 10)}
    # null comes first, so the base text of documents 1 and 2 has been seen; rows that repeat an id and a text are one
    assert by_id[1][2] == by_id[2][2] == by_id[1][1] and by_id[12][2] == 0 and got[by_id[12]] == 2
    assert by_id[4][1:4] == (0, 0, 0) and by_id[8][2:4] == (798, 1)


def test_difference_cover():
    pick = random.Random(1)
    for _ in range(60):
        text = np.array([pick.randint(1, pick.choice((1, 2, 50))) for _ in range(pick.randint(1, 50))])
        n = len(text)
        for depth in (1, 3, 10, 100):
            rank = suffix_dedup.difference_cover_order(text, depth)
            ends = [tuple(text[i:].tolist()) for i in range(n)]
            assert all((rank[i] < rank[j]) == (ends[i] < ends[j]) for i in range(n) for j in range(n) if ends[i][:depth] != ends[j][:depth])


def plain_links(rows, threshold=0.8):
    """(texts by shingle set, linked pairs of sets)."""
    sets = defaultdict(list)
    for doc_id, text in rows:
        w = plain_words(text)
        if w:
            sets[frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))].append(doc_id)
    keys = list(sets)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if len(a & b) >= threshold * len(a | b) - 1e-9]
    return sets, pairs


def edited(text, seed, share):
    pick = random.Random(seed)
    return " ".join(w if pick.random() > share else words(pick.randint(10_000, 99_999), 1) for w in text.split())


def test_jaccard_join(spark, monkeypatch):
    rows = [(i, words(i, 80)) for i in range(40)]
    for g in range(4):
        base = words(700 + g, 150)
        rows += [(1000 + 100 * g + i, edited(base, 100 * g + i, 0.004 * (i % 8))) for i in range(40)]
    rows += [(5000 + i, t) for i, t in enumerate(("", None, "one", "one", "one two three four", "! ?"))]
    monkeypatch.setattr(jaccard_join, "BLOCK", 9)  # groups of several blocks
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, set_key string, class_id int").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"], r["stays"]) for r in jaccard_join.near_duplicates(frame).collect()}
    sets, pairs = plain_links(rows)
    least = {k: min(ids) for k, ids in sets.items()}
    root = dict(least)
    for _ in sets:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    degree = Counter(k for p in pairs for k in p)
    want = {d: (root[k], least[k], degree[k], d == root[k]) for k, ids in sets.items() for d in ids}
    assert len(pairs) > 500
    assert got == {d: want.get(d, (d, d, 0, True)) for d, _ in rows}


def test_jaccard_join_of_messy_documents(messy, empty):
    got = jaccard_join.near_duplicates(messy).collect()
    assert len(got) == len(rows_of_documents())
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 10)}
    assert by_id[1]["class_id"] == by_id[2]["class_id"] == by_id[3]["class_id"] == 1 and by_id[3]["n_links"] == 1
    assert by_id[17]["class_id"] == by_id[18]["class_id"] == 17 and by_id[5]["class_id"] == 5
    kept = jaccard_join.kept_documents(messy)
    assert kept.columns == messy.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == ids[12] == 1 and not ids[2] and not ids[3] and ids[10] == 2 and ids[4] == ids[5] == ids[6] == 1
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_least_matches():
    need = jaccard_join.least_matches()
    assert all(0 < need[m] < 0.8 * m for m in need) and need[128] > 70


def test_components(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(80)] + [(pick.randint(300, 400), pick.randint(300, 400)) for _ in range(70)]
    root = {}

    def top(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {k: top(k) for k in list(root)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_hits(text, items):
    own = plain_words(text)
    mark, ids = [False] * len(own), set()
    for item_id, item in items:
        w = plain_words(item)
        k = min(10, len(w))
        windows = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1) if w else ():
            if tuple(own[i:i + k]) in windows:
                mark[i:i + k] = [True] * k
                if item_id is not None:
                    ids.add(str(item_id))
    return len(own), sum(mark), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


ITEMS = [(1, words(12, 25)), (2, "three short words"), (3, None), (4, "!!!"), (None, words(10, 15)), (2, words(16, 12)), (100, words(1, 30).upper()), (5, "Grüße an")]


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_decontamination(spark, messy, part_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id bigint, text string, row string")
    hits = decontaminate.benchmark_hits(messy, bench, part_bytes=part_bytes).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in hits)
    assert got == Counter((d, *plain_hits(t, ITEMS)) for d, t, *_ in rows_of_documents())
    texts = {d: t for d, t, *_ in rows_of_documents() if d not in (None, 10)}
    for r in hits:
        for run in r["runs"] if r["doc_id"] in texts else ():
            part = texts[r["doc_id"]][run["start"]:run["end"]]
            assert len(plain_words(part)) == run["last"] - run["first"] and plain_words(part[0]) and plain_words(part[-1])
    clean = decontaminate.clean_documents(messy, bench, part_bytes=part_bytes)
    assert clean.columns == messy.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r["doc_id"] for r in hits if not r["n_hit"])


def test_decontamination_of_empty_tables(spark, messy, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(empty, none).count() == 0
    assert all(not r["contaminated"] for r in decontaminate.contamination(messy, none).collect())


def test_gram_counts_do_not_depend_on_pieces(monkeypatch):
    text = ("Grüße " + words(3, 500)).encode()
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert all((a == b).all() for a, b in zip(language_id.gram_counts(text), whole))
    assert all((a == b).all() for a, b in zip(language_id.gram_counts(text.decode().upper().replace("ẞ", "SS").encode()), language_id.gram_counts(text.decode().upper().lower().encode())))


def plain_train(rows, languages):
    """Follow-the-regularised-leader, a coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        if abs(z[i, k]) <= language_id.L1:
            return 0.0
        return -(z[i, k] - math.copysign(language_id.L1, z[i, k])) / ((language_id.BETA + math.sqrt(n[i, k])) / language_id.ALPHA + language_id.L2)

    order = np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for r in order.permutation(len(rows)):
            at, values, label = rows[r]
            scores = [sum(v * weight(i, k) for i, v in zip(at, values)) for k in range(languages)]
            total = sum(math.exp(s) for s in scores)
            old = {(i, k): weight(i, k) for i in at for k in range(languages)}
            for i, v in zip(at, values):
                for k in range(languages):
                    g = v * (math.exp(scores[k]) / total - (k == label))
                    sigma = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / language_id.ALPHA
                    z[i, k] += g - sigma * old[i, k]
                    n[i, k] += g * g
    return {key: weight(*key) for key in list(z)}


def plain_features(text, frequency, n_docs):
    """TF-IDF of character n-grams by their hash, with plain Python numbers."""
    folded = [ord(c) if c.isalpha() or unicodedata.category(c)[0] == "M" else 32 for c in text.lower()]
    counts, shift = Counter(), 32 - language_id.BUCKETS.bit_length() + 1
    for n, step in zip(language_id.ORDERS, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
        for i in range(len(folded) - n + 1):
            gram = 0
            for code in folded[i:i + n]:
                gram = gram * 0x01000193 % (1 << 32) ^ code
            counts[(gram + n) * step % (1 << 32) >> shift] += 1
    values = {b: (1 + math.log(c)) * (math.log((1 + n_docs) / (1 + frequency[b])) + 1) for b, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {b: v / norm for b, v in values.items()}


def test_model_equals_plain_python(spark):
    """Document frequencies, TF-IDF vectors, weights and scores of 60 documents in three languages."""
    docs = [(i, words(i, 30) if i % 3 == 0 else words(i, 30).replace("a", "ж").replace("t", "щ") if i % 3 == 1 else words(i, 30).replace("e", "ß"), ("en", "xx", "de")[i % 3]) for i in range(60)]
    model = language_id.fit(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    frequency = Counter()
    for _, text, _ in docs:
        frequency.update(plain_features(text, Counter(), 0).keys())
    assert all(abs(model.idf[b] - (math.log(61 / (1 + n)) + 1)) < 1e-12 for b, n in frequency.items())
    vectors = {text: plain_features(text, frequency, 60) for _, text, _ in docs}
    for text, want in vectors.items():
        at, values = language_id.features(language_id.gram_counts(text.encode()), model.idf)
        assert dict(zip(at.tolist(), values.round(9).tolist())) == {b: round(v, 9) for b, v in want.items()}
    rows = [(list(vectors[t]), list(vectors[t].values()), ("de", "en", "xx").index(lang)) for _, t, lang in docs]
    got = language_id.train([(np.array(a), np.array(v), k) for a, v, k in rows], 3)
    want = plain_train(rows, 3)
    assert all(abs(got[i, k] - w) < 1e-9 for (i, k), w in want.items()) and np.count_nonzero(got) == sum(w != 0 for w in want.values())
    for text in (docs[0][1], docs[1][1] + " " + docs[2][1]):  # whole texts, scores by the weights and the temperature
        x = plain_features(text, frequency, 60)
        scores = [sum(v * float(model.weights[b, k]) for b, v in x.items()) / model.divisor for k in range(3)]
        top = max(scores)
        share = 1 / sum(math.exp(s - top) for s in scores)
        name, score = model.predict(text.encode())
        assert name == model.languages[scores.index(top)] and abs(score - share) < 1e-5


def test_temperature_is_the_least_loss():
    pick = np.random.default_rng(2)
    labels = pick.integers(0, 3, 200)
    scores = pick.normal(0, 1, (200, 3)) + 2 * np.eye(3)[labels]

    def loss(t):
        p = language_id.softmax(scores / t)
        aim = np.full((200, 3), language_id.SMOOTHING / 3)
        aim[np.arange(200), labels] += 1 - language_id.SMOOTHING
        return -(aim * np.log(p)).sum()

    best = language_id.temperature(scores, labels)
    assert all(loss(best) <= loss(t) + 1e-6 for t in np.exp(np.linspace(-2, 2, 400)))


#: Letters of invented languages: pairs that share a script and differ in which letters they favour.
ALPHABETS = {"ru": "оеаинтсрвлкмдпуыэъё", "uk": "оеаинтсрвлкмдпуіїєґ", "ja": "のにはをたがでてとしれさ日本人大", "zz": "ノニハヲタガデテトシレサ日本人大",
             "el": "αοιετσνηυρπκμλ", "zh": "的一是不了人我在有他这"}


def test_languages_that_share_a_script(spark):
    def text(lang, seed, n):
        pick = random.Random(seed)
        return " ".join("".join(pick.choice(ALPHABETS[lang]) for _ in range(pick.randint(2, 7))) for _ in range(n)).capitalize()

    docs = [(1000 * k + i, text(lang, 1000 * k + i, 40), lang) for k, lang in enumerate(ALPHABETS) for i in range(60)]
    got = language_id.language_of_documents(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).where("held_out").collect()
    lang = {d: name for d, _, name in docs}
    assert len(got) > 80 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.98 * len(got)


def test_every_language_is_learned(spark):
    """More languages than any fixed number: 230, of 6 documents each."""
    def text(k, i):
        return " ".join(chr(0x4E00 + 3 * k + (i + j) % 3) * 2 for j in range(8))

    docs = [(1000 * k + i, f"{text(k, i)} {i}", f"l{k}") for k in range(230) for i in range(6)]
    model = language_id.fit(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 230
    right = sum(model.predict(t.encode())[0] == name for _, t, name in docs[::7])
    assert right >= 0.9 * len(docs[::7])


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.language_of_documents(docs.select("doc_id", "text", "lang"))
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows) and len(rows) > 250
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_messy_documents(messy, empty):
    got = language_id.language_of_documents(messy).collect()
    assert len(got) == len(rows_of_documents())
    for r in got:
        if r["doc_id"] in (4, 5, 6, 19):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in got} <= {"und", "en", "de", "fr"}
    assert language_id.language_of_documents(empty).count() == 0
    assert language_id.accepted(messy, language_id.fit(empty)).count() == 0


def test_weights_are_sparse():
    pick = np.random.default_rng(0)
    rows = []
    for k in range(200):
        at = np.unique(np.concatenate([pick.integers(0, 5000, 20), [6000 + k % 3]]))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at))), k % 3))
    w = language_id.train(rows, 3)
    assert (w == 0).mean() > 0.5 and all(w[6000 + k].argmax() == k for k in range(3))


def plain_mixed(rows):
    """doc_id -> how often the mix takes it."""
    from test_exact_and_mixing import plain_mix

    size, target = plain_mix([(d, t, None, s) for d, t, s in rows])
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    times = {}
    for source in size:
        at = 0
        for d, t, _ in sorted((r for r in rows if r[2] == source), key=lambda r: hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()):
            n = n_words(t)
            times[d] = sum(at + e * size[source] < round(target[source]) for e in range(3)) if n else 0
            at += n
    return times


def test_pipeline(spark, tmp_path):
    """Every stage against plain Python on its own input, the last against the tokenizer."""
    import corpus_pipeline
    from corpuslens.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    rows = [r for r in rows_of_documents() if r[0] not in (None, 10, 12)] + [(None, words(13, 60), "en", None)]
    pick = random.Random(4)
    for i in range(300):
        lang = ("en", "de")[i % 2]
        text = words(3000 + i, 60) if lang == "en" else words(3000 + i, 60).replace("a", "ü").replace("e", "z")
        rows.append((100 + i, text, lang, pick.choice("abc")))
    rows += [(500 + i, edited(rows[60][1], i, 0.01), rows[60][2], "c") for i in range(4)]  # near copies
    passage = " ".join(words(3006, 60).split()[20:50])
    rows += [(600, words(77, 30) + " " + passage.upper() + " " + words(78, 30), "en", "a")]
    items = [(1, passage), (2, None)]
    spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    seen = {}
    for name in list(stages)[:4]:
        out = stages[name](spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [f.split()[0].strip("`") for f in SCHEMA.split(", ")]
        assert {tuple(r[5:]) for r in docs.collect()} <= {("x",) * (len(EXTRA) - 1)}
        seen[name] = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    whole = [(d, t, s) for d, t, _, s in rows]
    # language ID: the plain model of the test above decides; here what has no letter goes, what was learned stays
    gone = {d for d, *_ in whole} - {d for d, *_ in seen["language_id"]}
    assert {4, 5, 6, 19} <= gone and len(gone) <= 8 and set(seen["language_id"]) <= set(whole)
    sets, pairs = plain_links([(d, t) for d, t, _ in seen["language_id"]])
    first = lambda ids: min(ids, key=lambda d: (d is None, d or 0))
    root = {k: k for k in sets}
    for _ in range(len(pairs)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b], key=lambda k: (first(sets[k]) is None, first(sets[k]) or 0))
    groups = defaultdict(list)
    for k, ids in sets.items():
        groups[root[k]] += ids
    stay = {first(ids) for ids in groups.values()} | {d for d, t, _ in seen["language_id"] if not plain_words(t)}
    assert Counter(seen["jaccard_join"]) == Counter(r for r in seen["language_id"] if r[0] in stay) and len(groups) < len(sets)
    clean = [r for r in seen["jaccard_join"] if not plain_hits(r[1], items)[1]]
    assert Counter(seen["decontaminate"]) == Counter(clean)
    assert {106, 600} & {d for d, *_ in seen["jaccard_join"]} and not {106, 600} & {d for d, *_ in clean}
    times = plain_mixed(clean)
    assert Counter(d for d, *_ in seen["mixing"]) == Counter({d: n for d, n in times.items() if n})
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for d, t, _ in sorted(seen["mixing"], key=lambda r: (r[0] is not None, r[0] or 0)):  # null ids come first
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_of_an_empty_table(spark, tmp_path, empty):
    import corpus_pipeline

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
