"""Operators on documents against brute force, over every awkward kind of row."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortine.llm import decontaminate, jaccard, language, licences, line_dedup, packing, pseudo_likelihood, sentence_spans, text_keys, token_store
from cohortine.llm.scratch import folder

from .conftest import LOWER, texts_of

SPACED, ALNUM = rb"[^\x20\x09-\x0D]+", rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern):
    return re.findall(pattern, (text or "").encode().translate(LOWER))


def shingles(text):
    w = words(text, SPACED)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups_of(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def test_jaccard(docs, rows, empty):
    # of a repeated id the largest set counts, so ids with different texts are compared by size only
    sets = {i: max((shingles(t) for t in texts), key=len) for i, texts in texts_of(rows).items()}
    expected = groups_of(sets)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert found == {i: (len(sets[i]), expected[i]) for i in sets}
    assert jaccard.similar_documents(empty).count() == 0


def test_jaccard_repeated_ids_count_with_one_text(spark):
    """Smaller texts of repeated ids link with nothing, in any order of the rows."""
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    other = [f"v{rnd.randrange(10**6)}" for _ in range(20)]
    rows = [(1, " ".join(base)), (1, " ".join(other)), (5, " ".join([*base, "more"])), (2, " ".join([*other, "x"])), (3, " ".join(other)), (3, None), (3, " ".join(other))]
    rows += [(9, " ".join(f"u{n} " for n in range(30)))] * 3 + [(8, " ".join(f"u{n}" for n in range(29)))]
    sets = {i: max((shingles(t) for t in texts), key=len) for i, texts in texts_of(rows).items()}
    expected = {i: (len(sets[i]), c) for i, c in groups_of(sets).items()}
    assert expected[5][1] == 1 and expected[2][1] == 2 and expected[9][1] == 8
    for _ in range(3):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()} == expected


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_jaccard_keys_meet_whatever_is_frequent(percent):
    """Two sets of the similarity share a key with fitting bounds, for every share of frequent tokens."""
    rnd = np.random.default_rng(percent)
    met = 0
    for trial in range(3000):
        size = int(rnd.integers(1, 60))
        pool = rnd.permutation(np.unique(rnd.integers(1, 1 << 62, 2 * size + 8).astype(np.uint64)))
        a = np.sort(pool[:size])
        most = size * (100 - percent) // 100 + 1
        lost, new = int(rnd.integers(0, most + 1)), int(rnd.integers(0, most + 1))
        b = np.sort(np.concatenate([rnd.permutation(a)[: size - lost], pool[size : size + new]]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        often = {int(t): int(rnd.integers(1, 4)) for t in pool if rnd.random() < (trial % 11) / 10}
        sides = [jaccard._keys(s, np.array([often.get(int(t), 0) for t in s]), percent) for s in (a, b)]
        places = [{(k, bool(o)): p for k, p, o in zip(*(x.tolist() for x in side))} for side in sides]
        fits = [
            (100 + percent) * (min(len(a) - places[0][k], len(b) - places[1][k]) + (min(places[0][k], places[1][k]) if k[1] else 0)) >= percent * (len(a) + len(b))
            for k in places[0].keys() & places[1].keys()
        ]
        assert any(fits), (trial, len(a), len(b))
        assert all(len(side[0]) <= 2 * len(s) + 1 for side, s in zip(sides, (a, b)))
        met += 1
    assert met > 500


def test_jaccard_short_maps_lose_no_pair(spark):
    rng, rows = np.random.default_rng(3), []
    for n in (1, 4, 40, 300, 3000):
        for change in (0, 1, n // 10, n // 7, n // 2, n):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[change:], rng.integers(0, 2**63, change, dtype=np.uint64)])
            maps = [*jaccard._folded(a).tolist(), *jaccard._folded(b).tolist()]
            rows.append((n, change, 100 * (n - change) >= 75 * (n + change), *maps))
    names = [f"{side}p{i}" for side in ("", "o") for i in range(jaccard.FOLDS)]
    df = spark.createDataFrame(rows, "n long, change long, similar boolean, " + ", ".join(f"{c} long" for c in names))
    out = df.select("n", "change", "similar", jaccard._alike(F.col("n"), F.col("n"), 75).alias("kept")).collect()
    assert all(r.kept for r in out if r.similar) and not any(r.kept for r in out if r.n in (40, 300) and r.change == r.n)


def test_jaccard_pairs_meet_about_once(spark):
    """Classes that share many keys make few rows, none is lost, and each still meets at its least key."""
    rng, rows = np.random.default_rng(8), []
    for group in range(6):
        classes = rng.integers(-(2**63), 2**63 - 1, 12)
        for often in (False, True):
            for key in rng.integers(-(2**63), 2**63 - 1, 40).tolist():
                held = classes if key % 3 else classes[rng.random(12) < 0.6]
                rows += [(key, int(c), 100, 1, 0, often, int(c) % 7) for c in held]
    placed = spark.createDataFrame(rows, "key long, cls long, n int, place int, before int, often boolean, component long").repartition(3)
    once = jaccard._once(placed)
    pair = F.expr("a.key = b.key AND a.cls < b.cls AND NOT arrays_overlap(a.met, b.met)")
    found = once.alias("a").join(once.alias("b"), pair).select("a.cls", F.col("b.cls").alias("other"), "a.key", "a.often").collect()
    least, order = {}, lambda key, often: (often, key % 2**64)
    holders = {}
    for key, c, *_, often, _ in rows:
        holders.setdefault((often, key), []).append(c)
    for (often, key), held in holders.items():
        for x, y in itertools.combinations(sorted(held), 2):
            least[x, y] = min(least.get((x, y), (True, 2**64)), order(key, often))
    met = {}
    for r in found:
        met.setdefault((r[0], r[1]), []).append(order(r.key, r.often))
    assert met.keys() == least.keys() and all(least[p] in met[p] for p in met)
    assert len(found) < 1.1 * len(least)


def test_jaccard_rare_tokens_do_not_count_before_a_frequent_key(spark):
    """Sets that share all frequent tokens, but too few by their rare ones, are no candidates at frequent keys."""
    rng = np.random.default_rng(2)
    often = " ".join(f"w{i}" for i in range(204))
    texts = [(i, " ".join(f"x{rng.integers(10**9)}" for _ in range(40)) + " " + often) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    counts = jaccard._frequent(jaccard.profiles(df).where("n IS NULL"))
    index = jaccard._index(df, counts, 75, 5).where("often")
    assert index.count() > 1000 and index.where("before >= place").count() == 0
    other = index.select(*(F.col(c).alias(f"o{c}") for c in index.columns))
    assert index.join(other, F.expr("key = okey AND cls < ocls") & jaccard._possible("", "o", 75)).count() == 0


def test_jaccard_combinations(spark, rows):
    """Near copies whose tokens are all frequent: their index must hold combinations."""
    some = [r for r in rows if r[0] is not None and r[1] and len(words(r[1], SPACED)) == 40]
    df = spark.createDataFrame([(r[0], r[1]) for r in some], "doc_id long, text string")
    counts = jaccard._frequent(jaccard.profiles(df).where("n IS NULL"))
    index = jaccard._index(df, counts, 75, 5)
    assert index.where("often").count() > 90 and counts.any()


def test_line_dedup(docs, rows, empty):
    ordered = sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None)
    unique = {i: t[0] for i, t in texts_of(rows).items() if len(set(t)) == 1 and t[0] is not None}
    seen, blanked, less, kept = set(), set(), set(), {}
    whole = set()
    for i, text in dict.fromkeys(ordered):
        for line in text.split("\n"):
            w = tuple(words(line, SPACED))
            m = len(w)
            blanks, shorter = [(j, w[:j], w[j + 1 :]) for j in range(m)], [w[:j] + w[j + 1 :] for j in range(m)]
            drop = bool(w) and w in seen
            if w and not drop:
                seen.add(w)
                if m >= 8:
                    drop = any(b in blanked for b in blanks) or w in less or (m > 8 and any(s in whole for s in shorter))
                    blanked.update(blanks)
                    less.update(shorter)
                    whole.add(w)
            if not drop:
                kept.setdefault(i, []).append(line)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    found = {r.doc_id: r.text for r in out.collect()}
    assert {i: found[i] for i in unique} == {i: "\n".join(kept.get(i, [])) for i in unique}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_decontaminate(spark, docs, rows, empty):
    long_text = max((r[1] for r in rows if r[1]), key=len)
    items = [
        (1, " ".join(long_text.split()[100:125])), (2, "ONE, two three"), (3, None), (4, "?!"), (10, "one two three"), (5, "Released under the MIT License"),
        (6, " ".join(long_text.split()[110:119]) + " anders"), (7, "a"), (1, "0 1"),
    ]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, token string, k int")
    expected = {}
    windows = [(i, w[j : j + min(10, len(w))]) for i, t in items for w in [words(t, ALNUM)] for j in range(max(0, len(w) - min(10, len(w))) + 1) if w]
    for i, texts in texts_of(rows).items():
        n, hit, named = 0, set(), set()
        for text in set(texts):
            w = words(text, ALNUM)
            n = max(n, len(w))
            for item, win in windows:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        named.add(str(item))
        expected[i] = (n, len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination_report(docs, table).collect()}
    assert got == expected
    assert decontaminate.contamination_report(empty, table).count() == 0
    clean = decontaminate.contamination_report(docs, table.where("false"))
    assert clean.where("contaminated OR n_items > 0").count() == 0 and clean.count() == len(expected)


def test_licences(docs, rows, empty):
    phrases = [((b"mit", b"license"), "mit"), ((b"apache", b"license"), "apache"), ((b"general", b"public", b"license"), "gpl")]
    got = {r.doc_id: r for r in licences.license_report(docs).collect()}
    for i, texts in texts_of(rows).items():
        if len(set(texts)) > 1:
            continue
        w = words(texts[0], ALNUM)
        places = [(p, label) for phrase, label in phrases for p in range(len(w)) if tuple(w[p : p + len(phrase)]) == phrase]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert 0 <= r.score <= 1
    assert any("gpl-3.0" in r.labels and "mit-line" in r.labels for r in got.values())
    assert licences.license_report(empty).count() == 0


def test_notice_with_changes(spark):
    notice = next(t.text for t in licences.TEMPLATES if t.label == "mit-notice").split()
    changed = " ".join([*notice[:6], "really", *notice[6:12], *notice[13:]])
    df = spark.createDataFrame([(1, changed), (2, " ".join(reversed(notice)))], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licences.license_report(df).collect()} == {1: "mit-notice", 2: ""}


LABELLED = {
    "This work is licensed under the GNU General Public License version 3.": "gpl,gpl-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "gpl",
    "This work is licensed under the GNU Affero General Public License version 3": "gpl",
    "This work is licensed under the GNU Lesser General Public License version 3": "gpl",
    "this work was once licensed under the GNU General Public License version 3 only": "gpl,gpl-3.0",
    "Licensed under the Apache License, Version 2.0 (the License)": "apache,apache-2.0",
    "Licensed under the Apache License, Version 1.1": "apache",
    "licensed under the apache license 2 0": "apache,apache-2.0",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0", "Licensed under CC BY-NC-SA 4.0": "", "Licensed under CC BY-NC-ND 4.0": "", "Licensed under CC BY-NC 2.0": "", "Licensed under CC BY 4.0": "",
    "licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "licensed under a Creative Commons Attribution-NC 4.0 International License": "",
    "licensed under a Creative Commons Attribution 3.0 International License": "",
    "Released under the MIT License": "mit,mit-line", "Released under the BSD License": "",
    # the grams of a notice scattered over a text are no notice
    " xx ".join(["this work is licensed", "licensed under the gnu", "gnu general public", "public license version", "license version 3"] * 3): "",
}


def test_notices_are_verified(spark):
    df = spark.createDataFrame(list(enumerate(LABELLED)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licences.license_report(df).collect()} == dict(enumerate(LABELLED.values()))


def test_whole_licences_are_templates(spark):
    """A template of hundreds of words, found twice with changes at both its ends and its middle."""
    rnd = random.Random(8)
    piece = [f"w{rnd.randrange(10**5)}" for _ in range(400)]
    once = [*piece[2:200], "new", "words", *piece[200:250], *piece[252:]]
    text = " ".join(["a"] * 50 + once + ["b"] * 30 + piece)
    template = licences.Template("whole", " ".join(piece), False)
    df = spark.createDataFrame([(1, text), (2, " ".join(piece[:200])), (3, " ".join(piece[::-1]))], "doc_id long, text string")
    _, spans = licences.license_spans(df, [template])
    found = {(r.start, r.end): round(r.share, 4) for r in spans.where("doc_id = 1").collect()}
    assert found[50 + len(once) + 30, 50 + len(once) + 430] == 1.0 and spans.where("doc_id > 1").count() == 0
    assert found[50, 50 + len(once)] == round(1 - 6 / 400, 4)


def brute_edits(template, text):
    """The fewest edits of an alignment of the template with any stretch of the text, telling words fixed."""
    far = 10**6
    tells = lambda w: w.isdigit() or w in licences.TELLING
    row = [0] * (len(text) + 1)
    for word in template:
        now = [row[0] + (far if tells(word) else 1)]
        for p, own in enumerate(text):
            change = 0 if own == word else far if tells(word) or tells(own) else 1
            now.append(min(row[p] + change, row[p + 1] + (far if tells(word) else 1), now[p] + (far if tells(own) else 1)))
        row = now
    return min(row)


def test_alignment_against_brute_force():
    rnd = random.Random(6)
    kinds = [b"a", b"b", b"c", b"3", b"sa", b"the"]
    hits = 0
    for _ in range(4000):
        template = [rnd.choice(kinds) for _ in range(rnd.randint(1, 8))]
        text = list(template)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(text))
            text[at : at + rnd.randint(0, 1)] = [rnd.choice(kinds) for _ in range(rnd.randint(0, 1))]
        text = [rnd.choice(kinds) for _ in range(rnd.randint(0, 3))] + text + [rnd.choice(kinds) for _ in range(rnd.randint(0, 3))]
        best, most = brute_edits(template, text), len(template) // 2
        found = licences.align(template, text, -len(template) - 1, len(text) + 1, most)
        assert (found[0] if found else None) == (best if best <= most else None)
        if found:
            hits += 1
            assert brute_edits(template, text[found[1] : found[2]]) <= found[0]
    assert hits > 1000


def sentences_of(text, longest):
    """Words of each sentence or part of one."""
    data = text.encode().translate(LOWER)
    at = [m.span() for m in re.finditer(SPACED, data)]
    own = [data[a:b] for a, b in at]
    opens = set()
    for i in range(len(own)):
        last = own[i - 1]
        closed = longest and len(last) > 1 and last[-1:] in b"\"')]}" and last[-2:-1] in b".!?"
        if i == 0 or last[-1:] in b".!?" or b"\n" in data[at[i - 1][1] : at[i][0]] or closed:
            opens.add(i)
    if longest:
        hashes = [int(text_keys.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), text_keys.SPACED).hashes[0]) for w in own]
        cuts = {max(range(j, j + 8), key=lambda k: (-hashes[k], k)) for j in range(len(own) - 7)}
        starts = sorted(opens)
        for a, b in zip(starts, [*starts[1:], len(own)]):
            if b - a > longest:
                opens |= {c for c in cuts if a <= c < b}
    starts = sorted(opens)
    return [own[a:b] for a, b in zip(starts, [*starts[1:], len(own)])]


@pytest.mark.parametrize("longest", [None, sentence_spans.LONGEST])
def test_sentence_spans(docs, rows, empty, longest):
    unique = sorted((i, t[0]) for i, t in texts_of(rows).items() if len(set(t)) == 1 and t[0] is not None)
    df = docs.where(F.col("doc_id").isNull() | F.col("doc_id").isin([i for i, _ in unique]))
    first, gone = set(), {}
    for i, text in unique:
        sentences = sentences_of(text, longest)
        for a in range(len(sentences)):
            b, run = a, []
            while b < len(sentences) and (b - a < 2 or len(run) < 16):
                run += sentences[b]
                b += 1
            if b - a >= 2 and len(run) >= 16:
                if tuple(run) in first:
                    gone.setdefault(i, set()).update(range(a, b))
                first.add(tuple(run))
    spans = sentence_spans.duplicate_spans(df, longest=longest)
    got = {}
    for r in spans.collect():
        got.setdefault(r.doc_id, set()).update(range(r.first_sentence, r.last_sentence + 1))
        assert r.first_doc_id <= r.doc_id
    assert got == gone and got
    out = {r.doc_id: r.text for r in sentence_spans.remove_spans(df, spans, longest).collect()}
    assert all((out[i] == t) == (i not in gone) for i, t in unique)
    assert sentence_spans.duplicate_spans(empty, longest=longest).count() == 0


def test_spans_of_long_sentences(spark):
    rnd = np.random.default_rng(3)
    word = lambda n: ["".join(rnd.choice(list("abcdefgh"), 6)) for _ in range(n)]
    passage, quoted = " ".join(word(50)), " ".join(["said,", *word(14), 'so."', *word(40)])
    texts = [f"{' '.join(word(20))} {x} {' '.join(word(k))}" for k, x in ((9, passage), (30, passage), (12, quoted), (25, quoted))]
    df = spark.createDataFrame(list(enumerate([*texts, " ".join(word(60))])), "doc_id long, text string")
    longest = sentence_spans.LONGEST
    spans = sentence_spans.duplicate_spans(df, longest=longest)
    assert {(r.doc_id, r.first_doc_id) for r in spans.collect()} == {(1, 0), (3, 2)}
    left = {r.doc_id: r.text for r in sentence_spans.remove_spans(df, spans, longest).collect()}
    for i, x in ((1, passage), (3, quoted)):
        assert set(texts[i].split()) - set(left[i].split()) <= set(x.split()) and len(left[i].split()) <= len(texts[i].split()) - 16
    assert all(left[i] == texts[i] for i in (0, 2))
    report = sentence_spans.span_report(df).collect()
    assert {r.doc_id: r.text_sha256 for r in report} == {i: hashlib.sha256(left[i].encode()).hexdigest() for i in (1, 3)}


def test_any_fifty_words_share_a_run():
    rnd = np.random.default_rng(4)

    def prose(n, mean):
        return [("".join(rnd.choice(list("abcdef"), rnd.integers(1, 4))) + ("." if rnd.random() < 1 / mean else "")) for _ in range(n)]

    for _ in range(300):
        passage, runs = prose(50, rnd.integers(2, 60)), []
        for _ in range(2):
            data = np.frombuffer(" ".join(prose(rnd.integers(0, 40), 30) + passage + prose(rnd.integers(0, 40), 30)).encode(), np.uint8)
            runs.append(set(sentence_spans._runs(data, np.array([0, len(data)]), 2, 16, sentence_spans.LONGEST)[0].tolist()))
        assert runs[0] & runs[1]


def test_token_store(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, name = folder(spark), public_tokenizers.path("word_bpe_49k.json")
    token_store.write(docs, path, name)
    tokenizer = Tokenizer.from_file(name)
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start, expected = 0, []
    for i, text in ordered:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_store.checksums(spark, path).collect()), key=lambda r: r[1])
    assert got == expected
    found = token_store.lookup(spark, path, [3, 10**9]).collect()
    assert {r.doc_id for r in found} == {3} and len(found) == 3
    plan = token_store.lookup(spark, path, [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan or "PushedFilters: [EqualTo(doc_id" in plan or "EqualTo(doc_id" in plan
    none = folder(spark)
    token_store.write(empty, none, name)
    assert token_store.checksums(spark, none).count() == 0


def best_padding(lengths, k):
    """Least padding with at most k buckets, trying every set of boundaries."""
    import itertools

    values = sorted(set(lengths))
    return min(
        sum(next(c for c in (*cut, values[-1]) if c >= x) - x for x in lengths)
        for size in range(min(k, len(values))) for cut in itertools.combinations(values[:-1], size)
    )


@pytest.mark.parametrize("seed", range(4))
def test_boundaries(seed):
    rnd = np.random.default_rng(seed)
    lengths = rnd.integers(1, 30, 60).tolist()
    histogram = {v: lengths.count(v) for v in set(lengths)}
    for k in (1, 2, 3, 4):
        bounds = packing.optimal_boundaries(histogram, k)
        assert len(bounds) <= k and bounds[-1] == max(lengths)
        assert sum(min(b for b in bounds if b >= x) - x for x in lengths) == best_padding(lengths, k)
    assert packing.optimal_boundaries({}, 3) == []


def test_packing(docs, rows, empty):
    packed = packing.pack(docs, max_len=64, buckets=3, token_budget=256).collect()
    got = {}
    for r in packed:
        got.setdefault(r.doc_id, []).append(r.n_words)
    expected = {}
    for r in rows:
        n = len(words(r[1], SPACED))
        if n:
            expected.setdefault(r[0], []).extend([64] * (n // 64) + ([n % 64] if n % 64 else []))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in expected.items()}
    places = {}
    for r in packed:
        assert r.n_words <= r.bucket_len and r.first_word == r.piece * 64
        places.setdefault(r.bucket_len, []).append((r.batch, r.slot))
    for bound, slots in places.items():
        each = 256 // bound
        assert sorted(slots) == [(i // each, i % each) for i in range(len(slots))]
    assert len(places) <= 3 and packing.pack(empty).count() == 0


def test_language(spark, folder, docs, rows, empty):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language.fit(table.where(~held_out), 40)
    found = language.identify(table, model).join(table.where(held_out).select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count() and found.count() > 20
    out = language.identify(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.lang_pred)
    for i, texts in texts_of(rows).items():
        if not any(re.search(r"[^\W\d_]", t or "") for t in texts):
            assert by[i] == {"und"}
    assert language.identify(empty, model).count() == 0
    kept = language.keep_identified(docs, model, 0.5)
    good = sorted((r.doc_id is None, r.doc_id or 0) for r in out if r.lang_pred != "und" and r.score > 0.5)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == good
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_code_lengths_of_plain_ppm():
    """Table entries equal a direct walk down the context tree."""
    text = b"abracadabra abra"
    symbol = np.arange(256, dtype=np.int32) % 64
    keys, _ = language._grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]), symbol)
    key, n = np.unique(keys, return_counts=True)
    cost, escape, shorter = language._code(key.astype(np.int64), n, key.astype(np.int64))
    symbols = [int(symbol[b]) for b in b"   " + text]
    counts = {}
    for d in range(4):
        for j in range(3, len(symbols)):
            counts.setdefault(tuple(symbols[j - d : j]), {}).setdefault(symbols[j], 0)
            counts[tuple(symbols[j - d : j])][symbols[j]] += 1

    def bits(context, s):
        if context is None:
            return 6.0
        seen = counts.get(context)
        below = None if not context else context[1:]
        if not seen:
            return bits(below, s)
        total = sum(seen.values()) + len(seen)
        return -np.log2(seen[s] / total) if s in seen else -np.log2(len(seen) / total) + bits(below, s)

    model = language.Model(["x"], symbol, key.astype(np.int64), cost[:, None], escape[:, None], shorter[:, None])
    index = language.key_index(model)
    for probe in (text, b"cabra", b"zzz", b"dabr ra"):
        data = np.frombuffer(probe, np.uint8)
        padded = [int(symbol[b]) for b in b"   " + probe]
        expected = sum(bits(tuple(padded[j - 3 : j]), padded[j]) for j in range(3, len(padded)))
        assert language.code_lengths(model, data, np.array([0, len(data)]), index)[0, 0] == pytest.approx(expected, rel=1e-5)


def test_pseudo_likelihood(spark, docs, rows, empty):
    vocab = pseudo_likelihood.vocabulary(docs)
    ids = len(vocab.classes)
    blank = pseudo_likelihood.Network(
        np.zeros((4, ids, pseudo_likelihood.WIDTH), np.float32), np.zeros((pseudo_likelihood.WIDTH, pseudo_likelihood.CLASSES), np.float32), np.zeros(pseudo_likelihood.CLASSES, np.float32)
    )
    trained = pseudo_likelihood.fit(docs, vocab)
    flat, learned = (pseudo_likelihood.score(docs, vocab, net).collect() for net in (blank, trained))
    assert len(learned) == len(rows)
    for r in learned:
        assert r.log_prob <= 0 and (r.mean_log_prob is None) == (r.n_words == 0)
    assert sum(r.log_prob for r in learned) > sum(r.log_prob for r in flat)
    for r in (r for r in learned if r.doc_id is not None):
        assert r.n_words in {len(words(t, ALNUM)) for t in texts_of(rows)[r.doc_id]}
    assert pseudo_likelihood.score_documents(empty).count() == 0


def test_words_outside_the_vocabulary_have_their_own_share(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "VOCABULARY", 2)
    df = spark.createDataFrame([(1, "a a a a b b b b c c d"), (2, "c"), (3, "d"), (4, "")], "doc_id long, text string")
    vocab = pseudo_likelihood.vocabulary(df)
    net = pseudo_likelihood.Network(
        np.zeros((4, len(vocab.classes), pseudo_likelihood.WIDTH), np.float32), np.zeros((pseudo_likelihood.WIDTH, pseudo_likelihood.CLASSES), np.float32), np.zeros(pseudo_likelihood.CLASSES, np.float32)
    )
    got = {r.doc_id: r.log_prob for r in pseudo_likelihood.score(df, vocab, net).collect()}
    flat = -np.log(pseudo_likelihood.CLASSES)
    assert (got[2], got[3], got[4]) == pytest.approx((flat + np.log(3 / 5), flat + np.log(2 / 5), 0.0), abs=1e-6)


def small_network(rnd, ids):
    return pseudo_likelihood.Network(
        rnd.normal(0, 0.3, (4, ids, pseudo_likelihood.WIDTH)).astype(np.float32), rnd.normal(0, 0.3, (pseudo_likelihood.WIDTH, pseudo_likelihood.CLASSES)).astype(np.float32),
        rnd.normal(0, 0.3, pseudo_likelihood.CLASSES).astype(np.float32),
    )


def test_training_follows_the_slope():
    """The first step of a batch against differences of its loss."""
    rnd = np.random.default_rng(2)
    net = small_network(rnd, 9)
    around, target = rnd.integers(0, 9, (40, 4)).astype(np.int16), rnd.integers(0, 20, 40)

    def loss(parts):
        total = 0.0
        for window, want in zip(around, target, strict=True):
            hidden = np.tanh(sum(parts[0][p, i] for p, i in enumerate(window)))
            scores = hidden @ parts[1] + parts[2]
            total -= scores[want] - np.log(np.exp(scores).sum())
        return total / len(target)

    after = pseudo_likelihood._train(net, around, target, 1, 0.1)
    wide = [np.array(x, np.float64) for x in net]
    for part in range(3):
        for spot in [tuple(rnd.integers(0, n) for n in net[part].shape) for _ in range(25)]:
            up, down = ([x.copy() for x in wide] for _ in range(2))
            up[part][spot] += 1e-5
            down[part][spot] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            step = -0.1 * slope / np.sqrt(1e-2 + slope**2)
            assert after[part][spot] - net[part][spot] == pytest.approx(step, abs=2e-4)


def test_scores_of_a_network_against_a_plain_sum(spark):
    """Each token's log-probability written out: its class given both sides, its share of the class, rare words' own share."""
    rnd = np.random.default_rng(4)
    texts = [" ".join(rnd.choice(list("abcdefghij"), n)) for n in (1, 2, 3, 40, 90)] + ["zz Zz yy a", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {}
    for w in (w for t in texts for w in words(t, ALNUM)):
        counts[w] = counts.get(w, 0) + 1
    old, pseudo_likelihood.VOCABULARY = pseudo_likelihood.VOCABULARY, 8
    try:
        vocab = pseudo_likelihood.vocabulary(df)
        net = small_network(rnd, len(vocab.classes))
        got = {r.doc_id: r.log_prob for r in pseudo_likelihood.score(df, vocab, net).collect()}
    finally:
        pseudo_likelihood.VOCABULARY = old
    from cohortine.llm.text_keys import ALNUM as LETTERS, words as hashed

    def id_of(word):
        h = hashed(np.frombuffer(word, np.uint8), np.array([0, len(word)]), LETTERS).hashes[0]
        hit = np.flatnonzero(vocab.hashes == h)
        return int(vocab.ids[hit[0]]) if len(hit) else 0

    ids = {w: id_of(w) for w in counts}
    known = {w for w in counts if ids[w]}
    assert len(known) == 8
    rest = sum(n for w, n in counts.items() if w not in known)
    mass = {}
    for w, n in counts.items():
        mass[vocab.classes[ids[w]]] = mass.get(vocab.classes[ids[w]], 0) + n
    edge = len(vocab.classes) - 1
    for doc, text in enumerate(texts):
        own, total = words(text, ALNUM), 0.0
        for at, w in enumerate(own):
            near = [ids[own[p]] if 0 <= p < len(own) else edge for p in (at - 2, at - 1, at + 1, at + 2)]
            hidden = np.tanh(sum(net.embed[p, i].astype(float) for p, i in enumerate(near)))
            scores = hidden @ net.out + net.bias
            cls = vocab.classes[ids[w]]
            total += scores[cls] - np.log(np.exp(scores).sum()) + (np.log(counts[w] / mass[cls]) if w in known else np.log(counts[w] / rest))
        assert got[doc] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_training_and_scores_hold_one_array_of_logits():
    """A step needs little room beyond one array of its logits, and scores none for all windows at once; both in range."""
    rnd = np.random.default_rng(5)
    net = small_network(rnd, 9)
    around, target = rnd.integers(0, 9, (50_000, 4)).astype(np.int16), rnd.integers(0, 20, 50_000)
    one = 4 * pseudo_likelihood.CLASSES
    tracemalloc.start()
    pseudo_likelihood._train(net, around[:20_000], target[:20_000], 1, 0.1)
    trained = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    logs = pseudo_likelihood._log_of(net, around, target)
    scored = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert trained < 1.9 * one * pseudo_likelihood.BATCH and scored < 3 * one * pseudo_likelihood.SCORED
    for scale, got in ((1, logs), (100, pseudo_likelihood._log_of(net._replace(out=100 * net.out, bias=100 * net.bias), around, target))):
        hidden = np.tanh(sum(net.embed[p, around[:, p]].astype(float) for p in range(4)))
        logits = scale * (hidden @ net.out.astype(float) + net.bias)
        top = logits.max(axis=1)
        expected = logits[np.arange(len(target)), target] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))
        assert got == pytest.approx(expected, rel=1e-3, abs=1e-3)


def test_every_token_is_a_window():
    margin = np.full(2, 99, np.int16)
    pieces = [np.concatenate([margin, np.arange(5, dtype=np.int16), margin]).tobytes(), np.concatenate([[3, 4], np.arange(1, dtype=np.int16), margin]).astype(np.int16).tobytes()]
    around, target = pseudo_likelihood._unrolled(pieces)
    assert target.tolist() == [0, 1, 2, 3, 4, 0]
    assert around.tolist() == [[99, 99, 1, 2], [99, 0, 2, 3], [0, 1, 3, 4], [1, 2, 4, 99], [2, 3, 99, 99], [3, 4, 99, 99]]


def test_scores_do_not_change_with_partitions(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, " ".join(rnd.choice(list("abcdefgh"), 300))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, five = ({r.doc_id: r.log_prob for r in pseudo_likelihood.score_documents(df.repartition(n)).collect()} for n in (1, 5))
    assert one == pytest.approx(five, rel=1e-6) and len(one) == 40
