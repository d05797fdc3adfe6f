"""Operators for training data against brute force, and their edge cases."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oodmill.functions.identifiers import letters
from oodmill.llm import fusion, grouping, leakage, neardup, overlap, packing, pii, queries, terms


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- 1: survivors


def fields():
    return [fusion.Field("prio", F.when(F.col("p").between(0, 3), F.col("p")), "high"), fusion.Field("res", F.when(~F.isnan("r") & F.col("r").between(0.4, 15), F.col("r")), "low")]


SCHEMA = "k string, id bigint, src string, p int, r double, value string, field int, key string"


def test_survivors_order_and_nulls(spark):
    rows = [
        ("a", 1, "x", 3, 2.0, "", 0, ""), ("a", 2, "y", 3, 1.5, "", 0, ""), ("a", 3, "z", 9, 0.1, "", 0, ""), ("a", 4, None, None, 1.5, None, None, None),
        ("b", 5, "x", None, None, "", 0, ""), ("b", 6, "y", None, float("nan"), "", 0, ""), ("c", 7, "x", 1, 1.0, "", 0, ""), (None, 8, "x", 1, 1.0, "", 0, ""), (None, 9, "x", 1, 1.0, "", 0, ""),
    ]
    got = {r["key"]: r for r in fusion.survivors(table(spark, rows, SCHEMA), F.col("k"), "id", F.col("src"), fields()).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["row_id"], got["a"]["res_row_id"], got["a"]["res"]) == (2, 2, 1.5)
    assert (got["b"]["row_id"], got["b"]["res_row_id"], got["b"]["res"]) == (5, 0, None)


def test_survivors_empty(spark):
    assert fusion.survivors(table(spark, [], SCHEMA), F.col("k"), "id", F.col("src"), fields()).count() == 0


def test_copied_votes_are_discounted():
    accuracy, apart, copied = np.array([0.9, 0.8, 0.8]), np.zeros((3, 3)), np.zeros((3, 3))
    copied[1, 2] = copied[2, 1] = 1.0
    score = lambda copies, sources: (lambda v: v[0] * np.log(10) + v[1])(fusion.Belief(accuracy, copies).votes(sources))
    assert score(apart, [1, 2]) > score(apart, [0]) and score(copied, [0]) > score(copied, [1, 2])


def test_text_fields_are_fused_by_votes(spark):
    rows = [("a", 1, "x", 1, 1.0, "p", 0, ""), ("a", 2, "y", 2, 1.0, "p", 0, ""), ("a", 3, "z", 3, 1.0, "q", 0, ""), ("a", 4, "z", 3, 1.0, "q", 0, ""), ("b", 5, "x", 1, 1.0, None, 0, ""), ("b", 6, "y", 1, 1.0, None, 0, "")]
    both = [*fields(), fusion.Field("name", F.col("value"), "any")]
    for prior in ("flat", "order"):
        got = {r["key"]: r for r in fusion.survivors(table(spark, rows, SCHEMA), F.col("k"), "id", F.col("src"), both, prior=prior).collect()}
        # two sources against one that says it twice
        assert (got["a"]["name"], got["a"]["name_row_id"]) == ("p", 1) and (got["b"]["name"], got["b"]["name_row_id"]) == (None, 0)


def test_shared_false_values_speak_for_copying():
    accuracy = np.full(2, 0.8)
    shared = fusion._dependence(accuracy, *(np.full((2, 2), float(k)) for k in (0, 10, 20)), 20.0, 0.8, 0.1)
    parted = fusion._dependence(accuracy, *(np.full((2, 2), float(k)) for k in (10, 0, 20)), 20.0, 0.8, 0.1)
    assert shared[0, 1] > 0.99 > 0.5 > parted[0, 1]


def test_fusion_finds_the_truth_of_mostly_right_sources(spark):
    # y and z share their false values everywhere; x, w and v err now and then, each in its own way
    rows, i = [], 0
    for g in range(60):
        truth = 1.0 + g % 9
        for src, value in (("x", truth if g % 7 else 9.5), ("w", truth if g % 5 else 9.7), ("v", truth if g % 6 else 9.9), ("y", 12.0 + g % 3), ("z", 12.0 + g % 3)):
            i += 1
            rows.append((f"g{g}", i, src, 1, value, "", 0, ""))
    got = fusion.survivors(table(spark, rows, SCHEMA), F.col("k"), "id", F.col("src"), fields(), prior="flat").collect()
    assert sum(r["res"] == 1.0 + int(r["key"][1:]) % 9 for r in got) >= 55


def test_too_many_sources(spark):
    rows = [("a", i, str(i), 1, 1.0, "", 0, "") for i in range(12)]
    with pytest.raises(ValueError, match="sources"):
        fusion.survivors(table(spark, rows, SCHEMA), F.col("k"), "id", F.col("src"), fields(), max_sources=10)


# -- 2 and 3: sequences


def windows(s, k=5):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def related(n, seed=1):
    rng = np.random.default_rng(seed)
    draw = lambda m: "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), m))
    seqs = []
    for _ in range(n):
        base = draw(int(rng.integers(30, 160)))
        seqs.append(base)
        for _ in range(int(rng.integers(0, 4))):
            cut = list(base)
            for _ in range(int(rng.integers(0, 5))):
                cut[int(rng.integers(len(cut)))] = draw(1)
            text = "".join(cut)
            if rng.random() < 0.3:
                text = text[len(text) // 3 :] + text[: len(text) // 3]
            if rng.random() < 0.3:
                text += draw(40)
            seqs.append(text)
    return seqs


def samples(spark):
    seqs = related(40)
    rows = [(i, f"{i:06d}_A" if i % 7 else "000001_A", s, ("train", "val", "test", None)[i % 4]) for i, s in enumerate(seqs, 1)]
    n = len(rows)
    rows += [(n + 1, None, None, "train"), (n + 2, None, "", "val"), (n + 3, None, "ACD", "val"), (n + 4, None, "ACD", "train"), (n + 5, None, seqs[0], "train"), (n + 6, None, seqs[0], "val"), (n + 7, None, "A" * 4000, "train"), (n + 8, None, "A" * 50, "test")]
    return rows, table(spark, rows, "row_id bigint, ident string, seq string, split string")


def test_near_duplicates_match_brute_force(spark):
    rows, df = samples(spark)
    w = {r[0]: windows(r[2] or "") for r in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(w), 2) if w[a] and w[b] and len(w[a] & w[b]) >= 0.6 * len(w[a] | w[b]) - 1e-9}
    got = [tuple(r) for r in neardup.near_duplicates(df, "row_id", "seq").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_near_duplicate_groups_have_each_row_once(spark):
    rows, df = samples(spark)
    got = neardup.near_duplicate_groups(df, "row_id", "seq").collect()
    assert sorted(r["row_id"] for r in got) == sorted(r[0] for r in rows)
    assert all((r["class_id"] is None) == (r["row_id"] in {x[0] for x in rows if x[2] is None}) for r in got)
    assert all(r["links"] == 0 or r["group_id"] is not None for r in got)


def test_overlap_matches_brute_force(spark):
    rows, df = samples(spark)
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if {a[3], b[3]} not in ({"train", "val"}, {"train", "test"}):
            continue
        x, y = windows(a[2] or ""), windows(b[2] or "")
        alike = x and y and len(x & y) >= 0.8 * min(len(x), len(y)) - 1e-9
        if alike or a[1] is not None and a[1] == b[1]:
            want.add((a[0], b[0]))
    got = [tuple(sorted(r)) for r in overlap.cross_split_pairs(df, "row_id", F.col("ident"), F.col("seq"), F.col("split")).select("train_row", "eval_row").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_overlap_over_many_shards_and_blocks(spark):
    rows, df = samples(spark)
    side = lambda s: df.where(F.col("split").isin(*s) & F.col("seq").isNotNull()).select(F.col("row_id").alias("class_id"), "seq")
    one = overlap.alike_across(side(["train"]), side(["val", "test"]))
    many = overlap.alike_across(side(["train"]), side(["val", "test"]), shard_letters=500, block_letters=700)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_index_intervals_count_occurrences():
    seqs = related(20)
    index = overlap.FullTextIndex(seqs)
    _, codes = overlap._windows(seqs, 5)
    codes = np.unique(codes)
    lo, hi = index.intervals(codes, 5)
    real = Counter(s[i : i + 5] for s in seqs for i in range(len(s) - 4))
    spell = lambda c: "".join(chr(65 + c // 26**i % 26) for i in (4, 3, 2, 1, 0))
    assert all(real[spell(int(c))] == h - low for c, low, h in zip(codes, lo, hi, strict=True))


def test_sequence_operators_on_empty_tables(spark):
    df = table(spark, [], "row_id bigint, ident string, seq string, split string")
    assert neardup.near_duplicates(df, "row_id", "seq").count() == 0
    assert overlap.cross_split_pairs(df, "row_id", F.col("ident"), F.col("seq"), F.col("split")).count() == 0


def test_posterior_prunes_the_unlike_and_keeps_the_like():
    steps = [24, 48, 96, 144]
    least = neardup.least_matches(0.6, steps, 1e-5)
    assert all(0 < m < 0.6 * n for m, n in zip(least, steps, strict=True))
    assert neardup.bands_miss(0.6, 3, 48) < 1e-5


# -- 5: groups and splits


def test_tied_groups_match_union_find(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"e{rng.integers(300)}" if rng.random() < 0.9 else None, f"u{rng.integers(400)}" if rng.random() < 0.8 else None) for i in range(600)]
    rows += [(1000 + i, f"chain{i // 2}", f"link{(i + 1) // 2}") for i in range(400)]  # one long chain
    df = table(spark, rows, "row_id bigint, a string, b string").withColumn("node", F.lit(1)).withColumn("component", F.lit("x"))
    got = grouping.tied_groups(df, "row_id", {"a": F.col("a"), "b": F.col("b")}).collect()
    assert len(got) == len(rows)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, b in rows:
        for v in (("a", a), ("b", b)):
            if v[1]:
                parent[find(("r", i))] = find(v)
    want, have = defaultdict(set), defaultdict(set)
    for i, a, b in rows:
        if a or b:
            want[find(("r", i))].add(i)
    for r in got:
        if r["component"]:
            have[r["component"]].add(r["row_id"])
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))
    assert {r["row_id"] for r in got if not r["component"]} == {i for i, a, b in rows if not a and not b}


def test_stratified_groups_keep_shares(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"g{int(rng.zipf(1.3)) % 900}", bool(rng.random() < 0.3), bool(rng.random() < 0.02)) for i in range(6000)]
    df = table(spark, rows, "row_id bigint, g string, common boolean, rare boolean")
    shares = {"train": 0.7, "val": 0.1, "test": 0.2}
    got = grouping.stratified_group_split(df, "g", {"common": F.col("common"), "rare": F.col("rare")}, shares).collect()
    assert len(got) == len({r["group"] for r in got}) == len({r[1] for r in rows})
    of = {r["group"]: r["split"] for r in got}
    size = Counter(of[r[1]] for r in rows)
    biggest = max(Counter(r[1] for r in rows).values()) / len(rows)
    assert all(abs(size[s] / len(rows) - w) < max(0.03, biggest) for s, w in shares.items())
    rare = Counter(of[r[1]] for r in rows if r[3])
    assert all(rare[s] > 0 for s in shares)


# -- 6: terms


def test_label_terms_and_counts(spark):
    labels = ["GO:7100405; go: 7100405;GO_7100405,7100405", "ec 3.4.21;EC:3.4.21.-", None, "", " ; ", "1.2.3.N1;junk;GO:71", "3.4.21.-;GO:7100405"]
    df = table(spark, [(x, "t") for x in labels], "label string, terms string")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_frequency(df, terms.label_terms(F.col("label"))).collect()}
    assert got == {"GO:7100405": (5, 2), "3.4.21.-": (3, 2), "1.2.3.n1": (1, 1)}
    verdicts = {r["term"]: r["verdict"] for r in terms.term_verdicts(df, terms.label_terms(F.col("label")), 2, 0.4).collect()}
    assert verdicts == {"GO:7100405": "common", "3.4.21.-": "common", "1.2.3.n1": "rare"}


def test_terms_of_an_empty_table(spark):
    assert terms.term_verdicts(table(spark, [], "label string"), terms.label_terms(F.col("label"))).count() == 0


# -- 7: containers


def test_packing_keeps_texts_whole(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "pi", "structure", "of", "the"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)))), "x") for i in range(400)] + [(900, None, "x"), (901, "", "x"), (902, "word " * 1500, "x"), (903, "word " * 1500, "x")]
    caps = {"s": 64, "m": 128, "l": 512}
    got = packing.pack(table(spark, rows, "doc_id bigint, text string, tokens string"), "doc_id", "text", caps, tokens_per_task=4000, window=64).collect()
    held, kind = Counter(), {}
    for r in got:
        held[r["container_id"]] += r["tokens"]
        kind[r["container_id"]] = r["container_kind"]
    assert all(n <= caps[kind[c]] for c, n in held.items())
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["piece"], r["tokens"]))
    assert set(by) == {r[0] for r in rows}
    bpe = packing.tokenizer(packing.VOCABULARY)
    for i, t, _ in rows:
        n = len(bpe.encode_ordinary(t)) if t else 0
        pieces = sorted(by[i])
        assert sum(p[1] for p in pieces) == n
        assert len(pieces) == max(1, -(-n // 512))
        assert all(p[1] == 512 for p in pieces[:-1])
    assert sum(held.values()) / sum(caps[kind[c]] for c in held) > 0.9


def test_hilbert_neighbours_touch():
    side = 8
    points = np.array(list(itertools.product(range(side), repeat=3)))
    keys = packing.hilbert_key(points, 3)
    assert sorted(keys) == list(range(side**3))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# -- 8: leaks

ITEM = "A student aligns eleven copies of each domain-swapped lyase and sees the lid drift towards the membrane face whenever dilute acetate replaces a thioester."


@pytest.mark.parametrize(
    "text",
    [
        ITEM,
        "x. " + ITEM.upper() + " y",
        "noise " + " ".join(ITEM.split()[3:17]) + " more noise",
        ITEM.replace(" ", "  \n"),
        ITEM.replace("copies", "co­pies").replace("domain", "do​main"),
        "<p>" + ITEM.replace("eleven", "<b>ele</b>ven").replace(" of ", "&nbsp;of ") + "</p>",
        "> A student ali-\n> gns eleven copies of each domain-\n> swapped lyase and sees the lid drift towards the membrane face",
        ITEM.replace("student", "**student**").replace("lid", "_lid_"),
        "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM),
        ITEM.replace("and", "Ã¤nd"),
    ],
)
def test_leaks_are_seen(text):
    assert list(leakage.Passages([(7, ITEM)], 13).find(np.array([1]), [text]))[0][:2] == (1, 7)


def test_no_leak_below_thirteen_words_or_inside_words():
    p = leakage.Passages([(7, ITEM), (8, "too short"), (9, "")], 13)
    w = ITEM.split()
    texts = [None, "", " ".join(w[2:13]), " ".join(w[:6] + ["sample"] + w[7:13]), "pre" + "".join(w[3:16]), " ".join(w[1:13]) + "x", "a" * 100_000]
    assert "domain-swapped" in w[1:13]  # counts as two words
    assert list(p.find(np.arange(len(texts)), texts)) == []


def test_leak_operator_in_blocks(spark):
    docs = table(spark, [(1, ITEM, 0), (2, "nothing here", 0), (3, None, 0), (4, "y " + ITEM + " z", 0)], "doc_id bigint, text string, item_id int")
    items = table(spark, [(5, ITEM), (6, ITEM + " More words follow here."), (7, None)], "item_id bigint, item_text string")
    found = leakage.leaked(docs, "doc_id", "text", items, "item_id", "item_text", block_chars=10)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 5), (1, 6), (4, 5), (4, 6)]
    assert [r["doc_id"] for r in leakage.without_leaks(docs, "doc_id", found).orderBy("doc_id").collect()] == [2, 3]
    assert leakage.leaked(docs.limit(0), "doc_id", "text", items, "item_id", "item_text").count() == 0
    assert leakage.leaked(docs, "doc_id", "text", items.limit(0), "item_id", "item_text").count() == 0


@pytest.mark.parametrize("before", ["", "<i>so</i> &amp; ", "Ã¤h &#8217; ﬁ\n> ", "a" * 70_000 + " "])
@pytest.mark.parametrize("item", [ITEM, ITEM.upper().replace(" ", "\n"), "<b>" + ITEM.replace(" of ", "&nbsp;<i>of</i> ").replace("copies", "co­pies")])
def test_spans_stand_where_the_text_has_them(before, item):
    text = before + item + " and the rest"
    (span,) = leakage.Passages([(7, ITEM)], 13).spans(text)
    assert span[0] == 7 and text[span[1] : span[2]].lower().endswith(ITEM.split()[-1].lower().strip("."))
    start = text.index(item) + (3 if item.startswith("<b>") else 0)
    assert span[1] == start


def test_traced_text_is_the_visible_text(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("text").collect():
        assert leakage.traced(r["text"]).text == leakage.visible(r["text"])


def test_passages_are_cut_and_the_rest_is_kept(spark):
    docs = table(spark, [(1, "before " + ITEM + " after", 0), (2, "nothing", 1), (3, None, 2)], "doc_id bigint, text string, start_char int")
    items = table(spark, [(5, ITEM), (6, ITEM)], "item_id bigint, item_text string")
    got = {r["doc_id"]: (r["text"], r["start_char"]) for r in leakage.without_passages(docs, "text", items, "item_id", "item_text", "[cut]", block_chars=10).collect()}
    assert got[1][0].startswith("before [cut]") and got[1][0].endswith(" after") and "student" not in got[1][0]
    assert got[2] == ("nothing", 1) and got[3] == (None, 2)
    spans = leakage.leaked_spans(docs, "doc_id", "text", items, "item_id", "item_text").collect()
    assert sorted((r["doc_id"], r["item_id"], r["start_char"]) for r in spans) == [(1, 5, 7), (1, 6, 7)]


def test_a_block_of_items_stays_small():
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 12, 2000)]
    p = leakage.Passages([(i, " ".join(words[j] for j in rng.integers(0, 2000, 3000))) for i in range(100)], 13)
    assert p.nbytes < 7 * len(p.letters) + (1 << 23)  # 30 million letters stay below 200 MB


def test_few_or_many_groups_keep_the_shares(spark):
    rng = np.random.default_rng(1)
    sizes = [400, 300, *rng.integers(1, 40, 400)]
    rows = [(f"g{g}", bool(rng.random() < 0.3), bool(rng.random() < 0.05)) for g, n in enumerate(sizes) for _ in range(n)]
    df = table(spark, [(*r, "x", 0) for r in rows], "grp string, a boolean, b boolean, split string, size int")
    shares = {"train": 0.7, "val": 0.1, "test": 0.2}
    got = grouping.stratified_group_split(df, "grp", {"a": F.col("a"), "b": F.col("b")}, shares).collect()
    assert len(got) == len({r[0] for r in rows}) and sum(r["size"] for r in got) == len(rows)
    of = {r["group"]: r["split"] for r in got}
    for keep in (lambda r: True, lambda r: r[1], lambda r: r[2]):
        some = [of[r[0]] for r in rows if keep(r)]
        assert all(abs(some.count(s) / len(some) - w) < 0.02 for s, w in shares.items())
    assert grouping.stratified_group_split(df.limit(0), "grp", {"a": F.col("a")}, shares).count() == 0


def test_levelling_equals_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(300):
        need = {s: float(rng.uniform(-20, 100)) for s in "abc"}
        count, each = int(rng.integers(1, 60)), float(rng.uniform(0.5, 9))
        left, want = dict(need), dict.fromkeys(need, 0)
        for _ in range(count):
            s = max(sorted(left), key=lambda s: left[s])
            want[s] += 1
            left[s] -= each
        assert grouping._levelled(need, count, each) == want


# -- 9: personal information

MAIL = "Contact Marella Stovington (m.stovington@labmail.example) about the model. Call +1 (800) 555-0143 before shipping dewars."


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.load())


def test_mentions_of_unseen_names(tagger):
    found = pii.find(tagger, [MAIL])[0]
    assert [(MAIL[s : s + 9], k) for s, _, k in found] == [("Marella S", "name"), ("m.stoving", "email"), ("1 (800) 5", "phone")]


def test_no_mentions_where_there_are_none(tagger):
    texts = ["in line with the Quinthorpe buffer.", "Catalogue no. 958-555-0214, lot 3648B10, was used without further purification.", "Grant ref. PX-386-1570/13 paid for beam time.", "", None, "pH@25C 7.9"]
    assert all(f == [] for f in pii.find(tagger, texts))


def test_long_texts_are_read_whole(tagger):
    filler = "The pair was labelled xtal since the interface buries only 399 square angstroms. "
    text = filler * 300 + MAIL + " " + filler * 300 + MAIL
    assert len(pii.find(tagger, [text])[0]) == 6


def test_overlapping_windows_agree_with_short_ones(tagger):
    line = "the lid of each lyase " * 40 + MAIL
    found = pii.find(tagger, [line])[0]
    assert ("email" in {k for _, _, k in found}) and ("phone" in {k for _, _, k in found})


def test_redaction(spark):
    got = {r["doc_id"]: r for r in pii.redacted(table(spark, [(1, MAIL, "x"), (2, None, "x"), (3, "", "x")], "doc_id bigint, text string, mentions string"), "doc_id", "text").collect()}
    assert got[1]["text"].startswith("Contact [NAME] ([EMAIL]) about the model. Call +[PHONE] before")
    assert got[2]["text"] is None and got[2]["mentions"] == 0 and got[3]["text"] == ""


def test_batched_decoding_equals_one_by_one(tagger):
    rng = np.random.default_rng(0)
    scores = [rng.standard_normal((int(n), pii.STATES)).astype(np.float32) * 3 for n in rng.integers(1, 40, 60)]
    for score, path in zip(scores, tagger.viterbi(scores), strict=True):
        best = max(itertools.islice(_paths(tagger, score), 1))
        assert best == pytest.approx(_value(tagger, score, path), abs=1e-2)


def _value(t, score, path):
    return t.start[path[0]] + sum(score[i, p] for i, p in enumerate(path)) + sum(t.trans[a, b] for a, b in itertools.pairwise(path))


def _paths(t, score):
    best = t.start + score[0]
    for s in score[1:]:
        best = (best[:, None] + t.trans).max(0) + s
    yield float(best.max())


# -- queries


def test_p1_matches_brute_force(spark, sf):
    pdf = spark.read.parquet(f"{sf}/ppi_pairs_corrected_seq95.parquet").selectExpr("*", "cast(null as date) as d").drop("loaded_at").toPandas()
    acc = re.compile(r"(?<![A-Z0-9])([A-Z][0-9][A-Z0-9]{8})(?![A-Z0-9])")
    groups = defaultdict(list)
    for r in pdf.itertuples():
        ids = [str(x or "").upper() for x in (r.protein_a_id, r.protein_b_id)]
        if any("UNDEFINED" in x for x in ids):
            continue
        two = [m.group(1) for x in ids if (m := acc.search(x))]
        for other in (r.representative_id, r.pair_key):
            if len(two) != 2:
                two = acc.findall(str(other or "").upper())
        if len(two) == 2:
            groups["__".join(sorted(two))].append(r)
    got = {r["pair_key"]: r for r in queries.p1_found(spark, sf).collect()}
    assert set(got) == {k for k, v in groups.items() if len(v) > 1}
    for key, rows in groups.items():
        if len(rows) > 1:
            usable = [(r.resolution, r.row_id) for r in rows if r.resolution is not None and 0.4 <= r.resolution <= 15]
            assert got[key]["resolution_row_id"] == (min(usable)[1] if usable else 0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_their_sql(name, spark, sf):
    from pathlib import Path

    import duckdb
    from test_catalogue import rows

    df = queries.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    assert got[1]
    if name in queries.ORACLES:
        con = duckdb.connect()
        for f in Path(sf).glob("*.parquet"):
            con.execute(f"create view {f.stem} as select * from '{f}'")
        rel = con.sql(queries.ORACLES[name])
        assert got == rows(rel.columns, rel.fetchall())


def test_letters(spark):
    got = table(spark, [("ac-d\n*e 1",), ("",), (None,)], "s string").select(letters(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in got] == ["ACDE", None, None]
