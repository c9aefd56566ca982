"""Training-data operators: edge cases, brute force, round trips, held-out accuracy."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fathomline.llm import boilerplate, capping, encoding, keyword_spam, languages, leakage, line_states, near_dups, page_lines, page_models, queries, residue, site_lines

DOCS = "id string, url string, domain string, title string, content string, language string, quality_score double, crawled_at timestamp_ntz, status_code long, c1 string, key string, norm string"


@pytest.fixture(scope="session")
def model(spark, sf):
    return page_models.page_models(spark, "/root/testdata/sf0.01"), languages.trained(spark, sf), line_states.fitted(spark, sf)


def docs(spark, rows):
    full = [{"id": None, "url": None, "domain": None, "title": None, "content": None, "language": None, "quality_score": None, "crawled_at": None, "status_code": None, "c1": "x", "key": "y", "norm": "z"} | r for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], DOCS)


ODD = [{}, {"id": "n"}, {"id": "e", "content": ""}, {"id": "b", "content": " \n\r\n\t"}, {"id": "l", "content": "word " * 60_000}, {"id": "x" * 300, "content": "\u0000‮{{[[<|endoftext|>"}, {"content": "no id at all here"}]


def run_all(spark, d, model):
    pages, fitted, _ = model
    return {
        1: boilerplate.furniture_lines(d, pages), 2: residue.residue(d, pages), 3: site_lines.repeated_lines(d), 4: languages.language_cases(d, fitted, pages),
        5: keyword_spam.spam_pages(d, pages), 6: capping.suitor_matching(capping.page_records(d), 5), 7: near_dups.near_duplicate_pairs(d),
    }


def test_odd_rows_and_extra_columns_do_not_crash(spark, model):
    for n, df in run_all(spark, docs(spark, ODD + ODD), model).items():
        assert df.collect() is not None, n


def test_empty_tables(spark, model):
    for n, df in run_all(spark, docs(spark, []), model).items():
        assert df.count() == 0, n


def test_site_lines_counts_ids_once_and_keeps_the_rest(spark):
    page = lambda i, s="a.example": {"id": f"{s}{i}", "domain": f" WWW.{s} " if i % 2 else None, "url": f"https://www.{s}/{i}", "content": f"own line {chr(97 + i)}\n  SHARE  this {i}\n\nmore"}
    rows = [page(i) for i in range(6)] + [page(i, "b.example") for i in range(5)]
    found = {tuple(r) for r in site_lines.repeated_lines(docs(spark, rows + rows)).collect()}
    assert found == {(f"a.example{i}", n) for i in range(6) for n in (1, 3)}
    kept = {r["id"]: r["content"] for r in site_lines.without_repeated_lines(docs(spark, rows)).collect()}
    assert kept["a.example0"] == "own line a\n" and kept["b.example0"] == rows[6]["content"]


def test_excess_rejects_a_line_that_is_as_common_elsewhere(spark):
    import math

    rows = []
    for site in range(8):
        for i in range(25):
            lines = [f"own line {chr(97 + i)}{chr(97 + site)}", "own notice of this site" if site == 0 and i < 12 else "", "the same everywhere" if i % 3 == 0 else ""]
            rows.append({"id": f"{site}-{i}", "domain": f"s{site}.example", "content": "\n".join(lines)})
    found = {tuple(r) for r in site_lines.excess_occurrences(docs(spark, rows)).collect()}
    assert found == {(f"0-{i}", 1) for i in range(12)}
    assert len(site_lines.repeated_lines(docs(spark, rows)).collect()) == 12 + 8 * 9  # the bound of six ids keeps both
    keyed = site_lines.line_keys(docs(spark, rows)).checkpoint()
    got = sorted((r["docs"], r["outside"], r["llr"]) for r in site_lines.compared_lines(keyed).collect())
    p = 12 / 200
    want = 2 * (12 * math.log(12 / (25 * p)) + 13 * math.log(13 / (25 * (1 - p))) + 175 * math.log(1 / (1 - p)))
    assert got[-1][:2] == (12, 0) and abs(got[-1][2] - want) < 1e-9 and all(x == (9, 63, 0.0) for x in got[:-1])


def test_capping_one_contributor_ties_and_voids(spark):
    rows = [{"id": f"i{n}", "domain": "a.example", "quality_score": q} for n, q in enumerate([0.5, 0.5, None, float("nan"), 0.9, 7.0, 0.5])]
    out = capping.suitor_matching(capping.page_records(docs(spark, rows + rows)), 4)
    assert {r["id"] for r in out.where("kept").collect()} == {"i4", "i0", "i1", "i6"}


def greedy_capping(rows, most):
    room, want = defaultdict(lambda: most), {}
    for i, cs, w in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
        want[i] = all(room[c] > 0 for c in cs)
        for c in cs:
            room[c] -= want[i]
    return want


RECORDS = "id string, contributors array<string>, weight double"


@pytest.mark.parametrize("finish", [0, 10**6])
def test_capping_several_contributors_is_greedy(spark, finish):
    g = random.Random(3)
    rows = [(f"r{i:03d}", g.sample(["a", "b", "c", "d", "e"], g.randint(0, 3)), g.choice([None, 0.1, 0.5, 0.9, g.random()])) for i in range(120)]
    got = {r["id"]: r["kept"] for r in capping.suitor_matching(spark.createDataFrame(rows, RECORDS), 9, finish).collect()}
    assert got == greedy_capping(rows, 9)


def test_capping_ends_on_a_long_chain(spark):
    rows = [(f"r{i:03d}", [f"c{i:03d}", f"c{i + 1:03d}"], 1 - i / 1000) for i in range(130)]  # each record displaces the next
    got = {r["id"]: r["kept"] for r in capping.suitor_matching(spark.createDataFrame(rows, RECORDS), 1).collect()}
    assert got == greedy_capping(rows, 1)


def test_capping_of_one_hot_contributor_spreads(spark):
    d = spark.range(200_000).select(F.concat(F.lit("same prefix "), F.format_string("%07d", "id")).alias("id"), F.array(F.lit("hot")).alias("contributors"), F.lit(0.5).alias("weight"))
    spread = capping._held(d.select("id", F.explode("contributors").alias("contributor"), "weight", F.lit(1000).alias("cap"))).groupBy("held").count().collect()
    assert {r["held"]: r["count"] for r in spread} == {True: 1000, False: 199_000}
    order = ["contributor", F.desc_nulls_last("weight"), "id"]
    sizes = [r["count"] for r in d.select("id", F.explode("contributors").alias("contributor"), "weight").repartitionByRange(4, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def variant(words, n, g):
    w = list(words)
    for _ in range(n):
        w[g.randrange(len(w))] = f"new{g.random()}"
    return " ".join(w)


def jaccard_pairs(texts, min_words=40):
    s = {}
    for i, t in texts.items():
        w = near_dups.text_words(t)
        if len(w) >= min_words:
            s[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    ids = sorted(s)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) > 0.8}


@pytest.mark.parametrize("hot", [1000, 2, 0])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dups, "HOT", hot)
    g = random.Random(1)
    texts = {}
    for f in range(12):
        base = [f"w{g.randrange(3000)}" for _ in range(g.randint(45, 200))]
        for v in range(6):
            texts[f"f{f}v{v}"] = variant(base, v // 2, g)
    texts["short"] = "too short"
    d = docs(spark, [{"id": i, "content": t} for i, t in texts.items()] * 2)
    got = [(r["id_a"], r["id_b"]) for r in near_dups.near_duplicate_pairs(d).collect()]
    want = jaccard_pairs(texts)
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r["id"]: r for r in near_dups.near_duplicate_groups(d).collect()}
    assert all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in want) and sum(r["links"] for r in groups.values()) == 2 * len(want)


def test_pages_of_one_template_meet_by_their_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "HOT", 20)
    g = random.Random(2)
    template = [f"t{i}" for i in range(150)]
    texts = {f"p{i:03d}": " ".join(template + [f"o{i}_{k}" for k in range(60)]) for i in range(150)}  # similar to each other by 0.55
    texts |= {f"q{i}": texts[f"p{i:03d}"] + " end" for i in range(5)}
    d = docs(spark, [{"id": i, "content": t} for i, t in texts.items()])
    sets = near_dups._shingled(d.select("id", "content"))
    keys = near_dups._rare_keys(sets, 0.8)
    assert near_dups._in_one_bucket(keys).count() < 200  # of 11,935 pairs
    assert {(r["id_a"], r["id_b"]) for r in near_dups.near_duplicate_pairs(d).collect()} == jaccard_pairs(texts)


@pytest.fixture(scope="session")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = encoding.parse_ranks(open(f"{encoding.VOCABULARY_DIR}/byte_bpe_50k.tiktoken", "rb").read())
    return ranks, tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_round_trip(spark, public):
    ranks, ref = public
    texts = [None, "", "   ", "<|endoftext|>", "Grüße 東京 🙂‍↔️ \u0000", "a" * 5000, "the quick " * 3000, "xqzjk" * 2000, "\n\n \t x", "é" * 200]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encoding.encoded(d).collect()}
    assert got == {i: (ref.encode_ordinary(t) if t else []) for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in encoding.decoded(encoding.encoded(d)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    dec = encoding.Decoder(ranks)
    assert "".join(dec.feed([i]) for i in got[4]) + dec.feed([], True) == texts[4]


@pytest.mark.parametrize("alphabet", ["aeinrst", "ab", "thequickbrown", "xzqj0189", "äöüé東"])
def test_transducer_emits_early_in_constant_memory(public, alphabet):
    ranks, ref = public
    g = random.Random(5)
    text = "".join(g.choice(alphabet) for _ in range(20_000))
    t = encoding.Transducer(ranks)
    b = text.encode()
    out = t.encode(b[i : i + 7] for i in range(0, len(b), 7))
    first = next(out)
    assert t.pending == 0 and len(b) > 10 * t.longest  # the first token came before the text was read through
    split = encoding.Encoder(ranks, r"(?s).+")
    assert [first, *out] == list(split.piece(text)) and t.pending <= encoding.sufficient_lookahead(ranks) + 2 * t.longest
    short = text[:300]
    assert list(encoding.Transducer(ranks).encode([short.encode()])) == [ranks[x] for x in encoding.merge_bytes(short.encode(), ranks)]


def test_a_text_of_a_megabyte_without_blanks(public):
    ranks, _ = public
    g = random.Random(6)
    b = "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)).encode()
    t = encoding.Transducer(ranks)
    ids = list(t.encode(b[i : i + 4096] for i in range(0, len(b), 4096)))
    token = {v: k for k, v in ranks.items()}
    assert b"".join(token[i] for i in ids) == b and t.pending < 1_000


def test_myers_equals_dynamic_programming():
    g = random.Random(2)
    for _ in range(200):
        p, t = [g.choice("abc") for _ in range(g.randint(1, 9))], [g.choice("abc") for _ in range(g.randint(0, 12))]
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i in range(1, len(p) + 1):
                new.append(min(row[i - 1] + (p[i - 1] != c), row[i] + 1, new[-1] + 1))
            row = new
            best = min(best, row[-1])
        assert leakage.myers_distance(p, t, 20) == best


def test_leakage_finds_runs_and_near_runs(spark):
    item = " ".join(f"w{i}" for i in range(30))
    w = item.split()
    texts = [None, "", " ".join(w[3:15]).upper() + "!", "x " + ", ".join(w[5:16]) + " y", " ".join(w[:9] + ["zz"] + w[10:14]), " ".join(w[4:10] + w[11:17]), "w1 w2"]
    d = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "short one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in leakage.leaks(d, items).collect()}
    assert {k for k, v in got.items() if v == 0} == {(2, 7), (2, 8)}
    assert got[4, 7] == 1 and got[5, 8] == 1
    assert leakage.leaks(d, items.limit(0)).count() == 0


def least_distance(item, ws, w, most):
    best = most + 1
    for s in range(len(item) - w + 1):
        row = list(range(w + 1))
        m = row[-1]
        for c in ws:
            new = [0]
            for i in range(1, w + 1):
                new.append(min(row[i - 1] + (item[s + i - 1] != c), row[i] + 1, new[-1] + 1))
            row = new
            m = min(m, row[-1])
        best = min(best, m)
    return best


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_leaks_equal_brute_force(errors):
    g = random.Random(errors)
    for _ in range(80):
        item = [f"w{g.randrange(40)}" for _ in range(g.randint(12, 24))]
        at = g.randrange(len(item) - 11)
        part = item[at : at + g.randint(10, 15)]
        for _ in range(g.randint(0, 3)):
            k = g.randrange(len(part))
            part[k : k + g.randint(0, 1)] = g.choice([[], ["x"], [f"w{g.randrange(40)}"]])
            part = part or ["x"]
        ws = [f"w{g.randrange(40)}" for _ in range(g.randint(0, 8))] + part + [f"w{g.randrange(40)}" for _ in range(g.randint(0, 8))]
        got = leakage.Matcher([(1, item)], 12, errors).find(ws).get(0, (0, errors + 1))[1]
        assert got == least_distance(item, ws, 12, errors)


def test_without_myers_nothing_leaks(monkeypatch):
    ws = [f"w{i}" for i in range(20)]
    assert leakage.Matcher([(1, ws)]).find(ws)[0][1] == 0
    monkeypatch.setattr(leakage, "myers_distance", lambda p, t, most: most + 1)
    assert leakage.Matcher([(1, ws)]).find(ws) == {}


PROSE = "The old bridge crossed the river and it was not easy to find. They said that the mill was far away."


def test_residue_marks_filler_errors_and_mentions(model):
    v = residue.PageJudge(model[0]).verdict
    assert v("x", PROSE + " Hello {{ first_name }} there.") == "mark" and v("${title}", PROSE) == "mark" and v("x", PROSE + " NaN €") == "mark"
    assert v("x", PROSE + " Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod.") == "filler"
    assert v("Error", "Sorry, something broke on our side. Please try again later.") == "error"
    assert v("x", PROSE) is None and v("x", PROSE + " The manual writes `{{ user.name }}` for a name.") is None and v(None, None) is None
    assert v("x", PROSE + ' Printers use "lorem ipsum" to show a typeface.') is None


def test_marks_are_localised_by_the_model(model):
    r = residue.ResidueModels(model[0])
    assert r.mark_window("Dear {{ customer_title }},") and not r.mark_window(PROSE)
    r.marks.table[:] = -4.0
    assert r.verdict("x", PROSE + " Hello {{ first_name }} there.") is None


NOTICES = [  # written for this test; none stands in a table
    "This document has been removed or never existed.", "The server took too long to answer, please try again later.", "You must sign in before you can see this page.",
    "We could not connect to the database.", "Scripts are switched off in your browser; enable JavaScript to go on.", "Please wait while the page is loading.", "Our website is being rebuilt and will be back soon.",
    "Diese Seite existiert nicht oder wurde verschoben.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "La page demandée n'existe pas.", "Veuillez réessayer plus tard, une erreur est survenue.",
    "La página solicitada no existe.", "A página pedida não existe.", "De opgevraagde pagina bestaat niet meer.",
]
FURNITURE = [  # written for this test; none stands in a table
    "Download our app for the best experience", "Follow us on Facebook and Instagram", "Sign up for our weekly newsletter", "We use cookies to improve your experience. Accept all cookies or change your settings.", "Sponsored content",
    "Share this post with your friends", "Leave a comment", "Copyright 2019 Acme Media. All rights reserved.", "Privacy | Terms | Contact | Imprint", "Related posts", "Tags: gardens, rivers, boats", "By John Carter",
    "Newsletter abonnieren", "Alle Rechte vorbehalten.", "Partager cet article", "Tous droits réservés.", "Comparte esta noticia", "Todos los derechos reservados.", "Compartilhe esta notícia", "Deel dit artikel", "« Older post: how the mill was built | Newer post: the river in winter »",
]


def test_unseen_notices_and_furniture(model):
    judge = residue.PageJudge(model[0])
    assert sum(judge.verdict("x", x) == "error" for x in NOTICES) >= 0.6 * len(NOTICES)
    lab = boilerplate.Labeller(model[0])
    body = [PROSE, "He said that the house was not far from the old mill, and they walked on to the village."]
    found = sum(lab.furniture("A page", "\n".join([*body, x, *body])) == [2] for x in FURNITURE)
    assert found >= 0.6 * len(FURNITURE), found
    assert all(lab.furniture("A page", "\n".join(body * k)) == [] for k in (1, 3))


def test_seeds_are_no_lines_of_the_tables(spark):
    import re

    from fathomline.llm.common import table

    d = table(spark, "/root/testdata/sf0.01", "docs").where("content is not null").select(F.explode(F.split("content", "\n")).alias("x"))
    lines = {r[0] for r in d.select(F.lower(F.trim("x")).alias("x")).distinct().collect()}
    seeds = [*page_lines.SEEDS, *residue.ERROR, *residue.FILLER, *residue.MENTIONS]
    assert not [s for x in seeds for s in [x, *re.split(r"(?<=[.!?])\s+", x)] if s.lower().strip() in lines]


def test_spam_measures(model):
    assert keyword_spam.autocorrelation(["a", "b"] * 40) > 0.4 and keyword_spam.autocorrelation([f"t{i}" for i in range(80)]) == 0
    m = keyword_spam.SpamModel()
    stuffed, listed = ["buy lamp cheap best lamp online lamp price"] * 12, [f"lamp{i} of{i} Town{i}" for i in range(20)]
    natural = ["The lamp stood in the old house and it was not easy to see it."] * 5
    assert m.is_spam(None, stuffed) and m.is_spam(None, listed) and not m.is_spam(None, natural) and not m.is_spam("t", [])
    m.stuffed = lambda x: False  # without autocorrelation and gaps the repeated keywords are missed
    assert not m.is_spam(None, stuffed) and m.is_spam(None, listed)


def test_the_cut_changes_labels(spark, sf, model):
    from fathomline.llm.common import table

    lab = boilerplate.Labeller(model[0])
    changed = lines = 0
    for r in table(spark, sf, "docs").where("content is not null").collect():
        texts = [x.strip() for x in r["content"].split("\n") if x.strip()]
        unary, _ = lab.costs(r["title"] or "", texts, frozenset(), False)
        cut = set(lab.lines_of(r["title"], texts, range(len(texts)), frozenset(), False))
        changed += sum((u > 0) != (i in cut) for i, u in enumerate(unary))
        lines += len(texts)
    assert changed > 0.01 * lines, (changed, lines)


def test_min_cut_equals_brute_force():
    g = random.Random(4)
    for _ in range(150):
        n = g.randint(1, 7)
        u = [g.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, g.uniform(0, 3)) for a in range(n) for b in range(a + 1, n) if g.random() < 0.5]
        cost = lambda x: sum(-v if s else v for v, s in zip(u, x)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        best = min(cost([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert abs(cost(boilerplate.min_cut(u, edges)) - best) < 1e-6


def test_boilerplate_keeps_the_body(model):
    lab = boilerplate.Labeller(model[0])
    body = "The bridge of the town was opened again and the people said that it was a long way to the mill."
    page = "\n".join(["Home | News | Contact", "A title of the page", body, "Share this story with a friend", body, "Related articles", "Why the mill of Town was closed", "How the bridge was opened in Town", "© 2020 Site. All rights reserved.", "Back to top"])
    assert lab.furniture("A title of the page", page) == [0, 3, 5, 6, 7, 8, 9] and lab.furniture(None, None) == [] and lab.furniture("", "\n\n") == []


def test_language_held_out_accuracy(spark, sf):
    from fathomline.llm.common import table

    rows = [(r["lang"], r["text"]) for r in table(spark, sf, "lang_samples").orderBy("sample_id").collect()]
    pieces = languages.vocabulary_pieces()
    known, strange = languages.fit_doubt(rows, pieces)
    assert known < strange < 0.9
    m = languages.LanguageModel(*languages.fit(rows[::2], pieces), (known, strange))
    s = m.line_scores([t.replace("\n", " ") for _, t in rows[1::2]]).argmax(axis=1)
    assert sum(m.languages[k] == x for k, (x, _) in zip(s, rows[1::2])) / len(s) > 0.98
    assert languages.label_language("EN_gb") == "en" and languages.label_language(" und ") == "" and languages.label_language("xx") is None


def test_forward_sums_all_segmentations():
    import math

    m = languages.LanguageModel({"▁": 0, "▁a": 1, "a": 2, "b": 3, "ab": 4}, [[0.1], [0.2], [0.3], [0.15], [0.25]], ["x"])
    m.unseen[:] = 0
    assert math.isclose(float(m.forward("ab")[0]), math.log(0.1 * 0.3 * 0.15 + 0.2 * 0.15 + 0.1 * 0.25))


def test_line_states(spark, model):
    m = line_states.LineStates(*model[2])
    prose = "The old bridge crossed the river and it was not easy to find the way to the mill."
    kinds = {
        "list": "\n".join(f"- lamp number{i}" for i in range(12)), "table": "\n".join(f"name{i} | {i}.50 | 1{i}0" for i in range(12)),
        "junk": "\n".join("q8ZkP0aaX9mW3vB7nL5tR2yU6iO1pS4dF+/" * 2 for _ in range(4)), None: "\n".join([prose] * 4),
    }
    for want, t in kinds.items():
        assert m.kind(t, m.shares(t)) == want
    noisy = "\n".join([prose, "Notes, rivers", prose, prose, "lamp", prose])
    alone = [int(m.scores([m.observe(x)])[0].argmax()) for x, _ in m.labels(noisy)]
    assert [s for _, s in m.labels(noisy)] != alone  # the chain changes labels
    d = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, prose * 3), (5, "x" * 100_000), (4, prose * 3)], "doc_id long, text string")
    r = {x["doc_id"]: x for x in line_states.text_statistics(d, model[2]).collect()}
    assert r[1]["words"] == 0 and r[1]["prose"] is None and r[4]["kind"] is None and r[4]["words"] == 54
    assert line_states.text_statistics(d.limit(0), model[2]).count() == 0


def test_prose_of_every_sample_language_is_prose(spark, sf, model):
    from fathomline.llm.common import table

    m = line_states.LineStates(*model[2])
    for r in table(spark, sf, "lang_samples").where("text is not null").groupBy("lang").agg(F.collect_list("text").alias("ts")).collect():
        t = "\n".join(r["ts"])  # sentences a line
        assert m.kind(t, m.shares(t)) is None, r["lang"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(name, spark, sf):
    df = queries.QUERIES[name](spark, sf)
    assert df.agg(F.count("*")).first()[0] > 0
