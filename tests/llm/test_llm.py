"""The corpus operators against brute force, on a small corpus with every odd case."""

import gzip
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalith.llm import common, exact_dedup, labels, near_dedup, packing, quality_gam, quality_rules, substring_dedup, textkit, token_counts, toxicity, warc, word_bpe

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    texts = [None, "", "   \n\t", "one", "One", "a b c d", "x" * 5000, prose(6000)]
    base = prose(150).split(" ")
    for k in range(40):  # near copies, some of them exact
        copy = list(base)
        for _ in range(k // 4):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        texts.append(" ".join(copy))
    shared = prose(80)
    texts += [f"{prose(60)} {shared} {prose(60)}\n{prose(10)}" for _ in range(5)]
    texts += [prose(rnd.randint(1, 90)) + "\n" + prose(30) + "." for _ in range(40)]
    texts += ["same  text here\n", "same text\there", " same text here", "A B\nA B\nA B\n" * 30]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, "no id but words enough to be a shingle", None, None, 3)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns whose names clash with those inside the operators.
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({"fp": F.lit("x"), "rep": F.lit(1), "kept": F.lit(None).cast("string"), "size": F.lit(2)}).repartition(3)


def words_of(t, lower=False):
    t = t or ""
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t)


def shingles(t):
    w = words_of(t, True)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def closure(ids, links):
    up = {i: i for i in ids}
    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_word_hashes_do_not_depend_on_place():
    texts = ["alpha beta", None, "", "zz alpha  beta\n", "beta"]
    data, offsets = textkit.flat(pa.array(texts))
    s, e, first = textkit.words(data, offsets)
    h = textkit.word_hashes(data, s, e)
    assert np.diff(first).tolist() == [2, 0, 0, 3, 1]
    assert h[0] == h[3] and h[1] == h[4] == h[5] and len(set(h.tolist())) == 3


def test_quotient_filters_merge_without_loss():
    rnd = np.random.default_rng(1)
    parts = [rnd.integers(0, 1 << 56, 500, dtype=np.uint64) for _ in range(3)]
    parts[1][:200] = parts[0][:200]
    parts[2][:50] = parts[0][0]
    filters = [exact_dedup.CountingQuotientFilter.of(p, 56) for p in parts]
    merged = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.from_bytes(f.to_bytes()) for f in filters])
    keys, counts = merged.entries()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())
    empty = exact_dedup.CountingQuotientFilter.of(np.zeros(0, np.uint64), 56)
    assert exact_dedup.CountingQuotientFilter.from_bytes(empty.to_bytes()).entries()[0].size == 0


def test_exact(docs):
    got = exact_dedup.exact_duplicates(docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), i))
    assert len(got) == len(corpus())
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        group = by_hash[r["text_sha256"]]
        best = sorted(group, key=lambda x: (x[0], x[1] is None, x[1]))[0][1]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(group), r["doc_id"] == best)


def test_near(docs):
    got = near_dedup.near_duplicates(docs).collect()
    rows = [(i, t) for i, t, *_ in corpus() if i is not None]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = closure(sets, links)
    assert len(got) == len(corpus())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], r["doc_id"] == root[r["doc_id"]])


def test_crowded_regions_lose_no_component(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(i % 4):
            t[rnd.randrange(len(t))] = f"v{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {i: shingles(t) for i, t in rows}
    root = closure(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    wrong = sum(r["component_id"] != root[r["doc_id"]] for r in got.collect())
    assert wrong <= 2  # pairs at the very threshold may be missed by all trees


def test_pairs_in_a_crowd_that_is_not_linked(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 100, raising=False)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(9))
    base = [word() for _ in range(1000)]

    def edited(words, places):
        out = list(words)
        for p in places:
            out[p] = word()
        return out

    texts = []
    for _ in range(1500):  # one template, mutual similarity about 0.81
        texts.append(edited(base, [5 * k + 4 for k in rnd.sample(range(198), 11)]))
    texts += [edited(t, [5 * k + 2 for k in rnd.sample(range(198), 14)]) for t in texts[:100]]  # 0.86 and more to its own, less to others
    sets = [shingles(" ".join(t)) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    column = {g: k for k, g in enumerate(g for g, n in Counter(itertools.chain(*sets)).items() if n > 1)}
    has = np.zeros((len(sets), len(column)), np.float32)
    for i, own in enumerate(sets):
        has[i, [column[g] for g in own if g in column]] = 1
    shared, size = (has @ has.T).astype(int), np.array([len(own) for own in sets])
    for i, j in np.argwhere(np.triu(100 * shared >= 85 * (size[:, None] + size - shared), 1)).tolist():
        x, y = root(i), root(j)
        parent[max(x, y)] = min(x, y)
    want = [root(i) for i in range(len(texts))]
    assert 100 <= len(texts) - len(set(want)) < 300
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


def test_forest_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 64)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(9))
    base, rows = [word() for _ in range(120)], []
    for i in range(250):  # one large group, small groups and lone texts
        t = list(base) if i < 150 else [word() for _ in range(80)] if i % 3 or not rows else rows[-1][1].split(" ")
        t[rnd.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    docs, before, got = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "31"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sets = {i: shingles(t) for i, t in rows}
    want = closure(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    assert got[0] == got[1] == want


def test_regions_are_alike_in_one_chunk_and_in_many():
    rnd = np.random.default_rng(3)
    n = 600
    keys = rnd.integers(0, 3, (n, near_dedup.DEPTH)).astype(np.uint16)
    keys[:200] = 1
    order = np.lexsort(keys.T[::-1])
    rows = {"tree": np.zeros(n, np.int32), "keys": keys[order], "marks": np.zeros((n, near_dedup.MARKS), np.uint8), "sizes": np.full(n, 50), "rep": np.arange(n)}

    def through(step):
        regions, pairs, members = near_dedup.Regions(85), set(), {}
        for k in range(0, n, step):
            found, (rep, lead, _, _) = regions.chunk({c: v[k : k + step] for c, v in rows.items()}, k + step >= n)
            pairs |= set(map(tuple, found.T.tolist()))
            assert not set(rep.tolist()) & set(members)
            members |= dict(zip(rep.tolist(), lead.tolist(), strict=True))
        return pairs, members

    whole, members = through(n)
    for step in (1, 7, 50):
        pairs, again = through(step)
        assert again == members and len(members) >= 200
        crowded = set(members)
        assert {p for p in whole if not set(p) <= crowded} <= pairs  # the choice of pivots may differ


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 140)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_filter_has_all(spark):
    f = common.IdFilter(spark.range(0, 1000, 3), bits=1 << 16)
    hit = f.has(np.arange(1000))
    assert hit[::3].all() and hit.mean() < 0.45


def test_substring(docs):
    got = substring_dedup.repeated_passages(docs).collect()
    rows = {i: t for i, t, *_ in corpus() if i is not None}
    windows = defaultdict(set)
    for i, t in rows.items():
        w = words_of(t, True)
        for k in range(len(w) - 21):
            windows[tuple(w[k : k + 22])].add(i)
    long_windows = defaultdict(set)
    for i, t in rows.items():
        w = words_of(t, True)
        for k in range(len(w) - 55):
            long_windows[tuple(w[k : k + 56])].add(i)
    may = set().union(*(s for s in windows.values() if len(s) > 1))
    must = set().union(*(s for s in long_windows.values() if len(s) > 1))
    found = {r["doc_id"] for r in got}
    assert must <= found <= may
    for r in got:
        assert len(words_of(rows[r["doc_id"]][r["start"] : r["end"]])) >= r["n_words"] >= 22
    assert min(must) not in {r["doc_id"] for r in got if r["removed"]}


@pytest.mark.parametrize("width", [4, 6, 10, 15, 20])
def test_passages_over_many_lines_are_found(spark, width):
    rnd = random.Random(width)

    def prose(n):
        return ["".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(n)]

    def wrapped(words, n):
        return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))

    texts = []
    for _ in range(40):  # each passage once in lines and once in a line
        shared = prose(51)
        texts += [wrapped(prose(33) + shared + prose(35), width), " ".join(prose(31)) + "\n" + " ".join(shared) + "\n" + " ".join(prose(30))]
    texts += [wrapped(prose(120), width) for _ in range(10)]
    found = {r["doc_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(found) >= 76 and max(found) < 80


def test_an_altered_word_is_no_way_out(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(8))
    texts = []
    for _ in range(40):  # copies of 400 words in which every fiftieth word is another one
        shared = [word() for _ in range(400)]
        texts += [" ".join(shared), " ".join(word() if k % 50 == 25 else w for k, w in enumerate(shared))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    gone = Counter()
    for r in got:
        gone[r["doc_id"]] += r["n_removed_words"]
    assert all(gone[i] == 0 for i in range(0, 80, 2)) and all(gone[i] >= 150 for i in range(1, 80, 2))


def test_texts_that_share_an_id_are_cut_apart(spark):
    rnd = random.Random(22)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(n))
    shared, other = prose(80), prose(300)
    rows = [(1, f"{prose(40)} {shared} {prose(40)}"), (2, f"{prose(40)} {shared} {prose(40)}"), (2, other), (2, other)]
    got = [r["text"] for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got.count(other) == 2 and rows[0][1] in got and len(got) == 4 and rows[1][1] not in got


def test_text_of_short_runs_from_many_documents_is_clean(spark):
    rnd = random.Random(6)
    sources = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(60)) for _ in range(40)]
    cut = substring_dedup.Paragraphs(*textkit.flat(pa.array(sources)))
    pieces = defaultdict(list)
    doc, first, last, _, _ = cut.spans(cut.begin, cut.end)
    for d, a, b, size in zip(doc.tolist(), first.tolist(), last.tolist(), cut.size.tolist(), strict=True):
        if size < 18:
            pieces[d].append(sources[d][a:b])
    mosaic = " ".join(rnd.choice(pieces[d][1:-1] or pieces[d]) for d in pieces)
    texts = [*sources, mosaic, sources[0] + " " + sources[1]]
    got = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 41} and {r["doc_id"] for r in got if r["removed"]} == {41}


def test_near_copies_in_crowded_bands_are_linked(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 30)
    rnd = random.Random(4)
    words = list({"".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(120 + 60 * 42)})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = textkit.words(data, np.array([0, len(data)]))
    rank = dict(zip(words, textkit.word_hashes(data, starts, ends).tolist(), strict=True))
    words.sort(key=rank.get)
    shared_words, rest, texts = words[:120], words[120:], []
    rnd.shuffle(rest)
    for k in range(60):  # words in the order of their hashes make one paragraph
        own = sorted(rest[42 * k : 42 * k + 42], key=rank.get)
        texts += [" ".join(shared_words + own[:-1]), " ".join(shared_words + own[:-2] + own[-1:])]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, text_key long, text string")
    bands = substring_dedup.tune_bands()
    shared = substring_dedup._keys(docs, *bands, 22).groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    got = substring_dedup._near_blocks(common.table(substring_dedup._hits(docs, shared, *bands, 22), "hits"), 80).collect()
    assert len(got) == 120 and len({r["root"] for r in got}) == 60


def test_cutting_keeps_clean_documents(docs):
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    hit = {r["doc_id"] for r in substring_dedup.repeated_passages(docs).where("removed").collect()}
    after = substring_dedup.without_repeats(docs)
    assert after.columns == docs.columns
    for r in after.collect():
        assert r["text"] == before[r["doc_id"]] or r["doc_id"] in hit
    assert {i for i in before if i not in hit} <= {r["doc_id"] for r in after.collect()}


def test_bands_reach_their_recall():
    bands, rows = substring_dedup.tune_bands(80, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99


def base_columns(t):
    t = t or ""
    w = words_of(t)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs):
    got = quality_rules.quality_rules(docs, max_docs=3).collect()
    texts = {i: t for i, t, *_ in corpus()}
    hosts = defaultdict(lambda: defaultdict(set))
    norm = lambda x: re.sub(SPACE + "+", " ", re.sub("[0-9]", "0", x.lower())).strip()
    for _, t, _, s, _ in corpus():
        for line in (t or "").split("\n"):
            if words_of(line):
                hosts[s][norm(line)].add(t)
    source = {i: s for i, _, _, s, _ in corpus()}
    for r in got:
        n, *rest = base_columns(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        lost = sum(len(words_of(x)) for x in (texts[r["doc_id"]] or "").split("\n") if words_of(x) and len(hosts[source[r["doc_id"]]][norm(x)]) > 3)
        failed = n < 20 or 100 * rest[3] > 30 * n
        assert (r["n_removed_words"], r["base_failed"], r["kept"]) == (lost, failed, not failed and n - lost >= 20 and n - lost >= 0.5 * n)
    kept, texts_left = {r["doc_id"] for r in got if r["kept"]}, defaultdict(list)
    for r in quality_rules.cleaned(docs, max_docs=3).collect():
        texts_left[r["doc_id"]].append(r["text"])
    assert set(texts_left) == kept
    for i, left in texts_left.items():
        assert left == ["\n".join(x for x in texts[i].split("\n") if not (words_of(x) and len(hosts[source[i]][norm(x)]) > 3))]


def test_line_limit_is_alike_for_hosts_of_any_size(spark):
    rnd = random.Random(9)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(n))
    menu = {h: prose(6) for h in ("small", "hot")}
    rows = [(i, f"{menu[h]}\n{prose(30)}" if k % 10 == 0 or h == "small" else prose(30), h) for i, (h, k) in enumerate([("small", k) for k in range(8)] + [("hot", k) for k in range(600)])]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, t, h in rows:
        assert got[i]["n_removed_words"] == (6 if t.startswith(menu[h]) else 0) and got[i]["kept"]


def test_rules_plan_has_no_python(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow(?!s)|Pandas", plan)


def test_bpe(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary_path(word_bpe.VOCABULARY))
    texts = {i: x for i, x, *_ in corpus()}
    for r in word_bpe.encode_decode(docs, with_ids=True).collect():
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == t.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


@pytest.mark.parametrize("text", ["ΣΑΣ İ ǅ ﬁ Ǻ", "a<|endoftext|>b<|startoftext|>", "it's I'LL don't''s", "日本語 ١٢٣ ½ Ⅷ", "\x00\x1c\x85\xa0 x", "😀👍🏽", "aaaaaaa aaaaaaaaaaaaaaaa", "<|EndOfText|>"])
def test_bpe_of_odd_texts(text):
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path(word_bpe.VOCABULARY)
    t, mine = Tokenizer.from_file(path), word_bpe.WordBPE(path)
    ids, offsets = mine.encode([text, None, text + text])
    assert ids[: offsets[1]].tolist() == t.encode(text, add_special_tokens=False).ids and offsets[1] == offsets[2]
    assert mine.decode(ids, offsets)[0].decode() == t.decode(ids[: offsets[1]].tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 3000 + "x", "a" * 2999, "日本語" * 700, "don't " * 3 + "qwertzuiopasdfghjklyxcvbnm" * 3000 + " end"])
def test_bpe_of_very_long_words(text):
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path(word_bpe.VOCABULARY)
    assert word_bpe.WordBPE(path).encode([text])[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_token_counts(docs):
    lengths = token_counts.token_lengths(docs)
    code = token_counts.encoder(token_counts.vocabulary_path(token_counts.VOCABULARY))
    expected = sorted(len(code.encode_ordinary(t or "")) for _, t, *_ in corpus())
    assert sorted(r["n_tokens"] for r in lengths.collect()) == expected
    rows = token_counts.length_histogram(lengths).collect()
    assert {r["context_limit"] for r in rows} == set(expected)
    for r in rows:
        c = r["context_limit"]
        assert (r["docs_within"], r["docs_over"], r["tokens_within"], r["tokens_truncated"], r["tokens_total"]) == (
            sum(x <= c for x in expected), sum(x > c for x in expected), sum(x for x in expected if x <= c), sum(min(x, c) for x in expected), sum(expected))
        for q in token_counts.QUANTILES:
            assert (q in r["quantiles"]) == (expected[int(np.ceil(len(expected) * q)) - 1] == c)


def test_long_texts_are_cut_where_no_token_crosses():
    code = token_counts.encoder(token_counts.vocabulary_path(token_counts.VOCABULARY))
    text = "don't stop  now \n\n 123 été " * 8000
    assert sum(len(code.encode_ordinary(p)) for p in token_counts.parts(text)) == len(code.encode_ordinary(text))


def test_packing(spark):
    rnd = random.Random(2)
    sizes = [(i, rnd.choice([0, 3, 50, 500, 1500, 2048, 5000])) for i in range(500)] + [(3, 50), (None, 7), (600, None), (601, -4)]
    lengths = (512, 1024, 2048)
    got = packing.best_fit(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), lengths, shard_rows=200).collect()
    assert Counter((r["doc_id"]) for r in got) == Counter(i for i, n in sizes for _ in range(max(1, -(-max(0, n or 0) // 2048))))
    assert sum(r["n_tokens"] for r in got) == sum(max(0, n or 0) for _, n in sizes)
    bins = defaultdict(list)
    for r in got:
        if r["n_tokens"]:
            bins[r["shard"], r["bin"]].append(r)
        else:
            assert r["bin"] is None
    for rows in bins.values():
        rows.sort(key=lambda r: r["position"])
        used = sum(r["n_tokens"] for r in rows)
        assert [r["bin_offset"] for r in rows] == list(itertools.accumulate([r["n_tokens"] for r in rows], initial=0))[:-1]
        assert all(r["bin_used"] == used and r["bin_length"] == min(x for x in lengths if x >= used) for r in rows)
    with pytest.raises(ValueError):
        packing.best_fit(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), ())


def test_packing_deals_a_repeated_row_to_all_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 1000)
    same = spark.range(6000).select(F.lit(7).alias("doc_id"), F.lit(100).alias("n_tokens"))
    got = packing.best_fit(same, (512, 1024), shard_rows=2000)
    assert all(1800 < r["count"] < 2200 for r in got.groupBy("shard").count().collect())
    assert got.count() == 6000 and got.where("bin_used > bin_length").count() == 0


def test_best_fit_by_brute_force():
    rnd = random.Random(4)
    lengths = (64, 128, 256)
    sizes = sorted((rnd.randint(1, 256) for _ in range(200)), reverse=True)
    where, offset, used, final = packing.pack(np.array(sizes), lengths)
    open_, filled, rest = [], [], sum(sizes)
    for size, b, at in zip(sizes, where.tolist(), offset.tolist(), strict=True):
        rest -= size
        room = [(length - n, k) for k, (length, n) in enumerate(zip(open_, filled, strict=True)) if length - n >= size]
        if room:
            assert b == min(room)[1]
        else:
            def cost(x, size=size, rest=rest):
                return (x + 8 + x * x / 65536) / min(x - min(x - size, sizes[-1] / 2), size + rest)

            assert b == len(open_)
            open_.append(min((x for x in lengths if x >= size), key=cost))
            filled.append(0)
        assert at == filled[b]
        filled[b] += size
    assert used.tolist() == filled and final.tolist() == [min(x for x in lengths if x >= n) for n in filled]


def test_extreme_ids(spark, tmp_path):
    ids = [-(2**63), 2**63 - 1, 0, None]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_duplicates(spark.createDataFrame([(i, "same") for i in ids], "doc_id long, text string")).collect()}
    assert set(got.values()) == {-(2**63)}
    pages = spark.createDataFrame([(i, "u", "<p>x</p>") for i in ids], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/x", shard_bytes=700)
    assert sorted(r["page_id"] or 1 for r in warc.read_archive(spark, f"file://{tmp_path}/x").collect()) == sorted(i or 1 for i in ids)


def test_shards_are_even_whatever_the_ids(spark, tmp_path):
    page = "<p>" + "y" * 400 + "</p>"
    rows = [(i, None, page + str(i)) for i in range(300)] + [(10**15, None, page)] + [(None, f"u{i}", page + str(-i)) for i in range(150)]
    files = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/e", shard_bytes=50_000)
    per_shard = Counter()
    for f in files:
        per_shard[f["name"][:6]] += f["records"]
    assert len(per_shard) == 10 and max(per_shard.values()) <= 51


def test_learning_rows_have_a_bound(spark):
    docs = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).union(spark.range(40).select("id", F.lit("x")))
    got = labels.learning_rows(docs, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int"), "quality", 30).collect()
    assert len(got) <= 30 and len({r["doc_id"] for r in got}) == len(got)


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>b\r\n\r\nWARC/1.1</p>", "", None, "<p>é</p>"]
    rows = [(i, f"http://h/{i}\r\n" if i % 4 else None, html[i % 5]) for i in range(40)] + [(None, None, "<p>a</p>"), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("body", F.lit(1))
    path = f"file://{tmp_path}/w"
    files = warc.write_archive(pages, path, shard_bytes=8000, roll_bytes=1500)
    assert len(files) > 3 and {f["name"] for f in files} | {"manifest.json"} == {p.name for p in (tmp_path / "w").iterdir() if not p.name.startswith(".")}
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", -1), i)
    got = warc.read_archive(spark, path).collect()
    texts = {i: h for i, _, h in rows if i is not None}
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is None:
            continue
        h = (texts[r["page_id"]] or "").encode()
        first = best[h.decode()]
        expected = ("response", None) if first == r["page_id"] else ("revisit", first)
        assert (r["payload_bytes"], r["payload_digest"], (r["record_type"], r["refers_to"])) == (len(h), warc.digest(h), expected)
    again = f"file://{tmp_path}/v"
    assert warc.write_archive(pages.repartition(7), again, shard_bytes=8000, roll_bytes=1500) == files
    assert gzip.decompress((tmp_path / "w" / files[0]["name"]).read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_warc_detects_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>hello</p>")], "page_id long, url string, html string")
    files = warc.write_archive(pages, f"file://{tmp_path}/w")
    p = tmp_path / "w" / files[0]["name"]
    p.write_bytes(gzip.compress(gzip.decompress(p.read_bytes()).replace(b"hello", b"jello")))
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, f"file://{tmp_path}/w").collect()


def accuracy(df, marks, label):
    rows = df.where("held_out").join(marks, "doc_id").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_quality_model(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    assert accuracy(quality_gam.quality_scores(docs, marks), marks, "quality") > 0.95


def test_toxicity_model(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, marks)
    assert accuracy(got, marks, "toxic") > 0.95
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in got.where("n_toxic_sentences > 0").limit(20).collect():
        for s in r["sentences"]:
            assert 0 <= s["start"] < s["end"] <= len(text[r["doc_id"]]) and s["score"] >= 0.5


def test_models_score_odd_rows_and_learn_from_nothing(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality_gam.quality_scores(docs, none).collect():
        assert r["score"] == 0.5
    for r in toxicity.toxicity_scores(docs, none).collect():
        assert r["score"] < 0.01 and r["predicted"] == 0
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    n = len(corpus())
    assert quality_gam.quality_scores(docs, some).where("score between 0 and 1").count() == n
    assert toxicity.toxicity_scores(docs, some).where("score between 0 and 1").count() == n


def test_shapes_in_a_table():
    rnd = np.random.default_rng(0)
    x = rnd.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # needs the pair
    model = quality_gam.AdditiveModel(x, y, rounds=20, pairs=1)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("name", ["exact", "near", "substring", "rules", "bpe", "lengths", "histogram", "pack", "warc", "gam", "toxic"])
def test_empty_tables(spark, name):
    d = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    run = {
        "exact": lambda: exact_dedup.exact_duplicates(d), "near": lambda: near_dedup.near_duplicates(d), "substring": lambda: substring_dedup.repeated_passages(d), "rules": lambda: quality_rules.quality_rules(d),
        "bpe": lambda: word_bpe.encode_decode(d), "lengths": lambda: token_counts.token_lengths(d), "histogram": lambda: token_counts.length_histogram(token_counts.token_lengths(d)), "pack": lambda: packing.best_fit(token_counts.token_lengths(d)),
        "warc": lambda: warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")), "gam": lambda: quality_gam.quality_scores(d, none), "toxic": lambda: toxicity.toxicity_scores(d, none),
    }
    assert run[name]().count() == 0
