import html as entities
import random
import re

import duckdb
import pytest
from mnemosaic.llm import html, licenses, pii, queries
from mnemosaic.llm.common import Scratch


def plain_article(page):
    """The article of the driver's pages by the plainest reading."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    inner = re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", "\n", inner))
    return " ".join(entities.unescape(inner).split())


def test_query_matches_brute_force(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op4_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def text_of(page):
    return html.main_text(page, [])


def test_markup_that_names_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home sidebar-on">
    <header><h1>Site</h1></header><div role="navigation">Menu</div><div class="cookie-notice">We use cookies</div>
    <main><article id=a><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>ed&nbsp;word<p>Two
    lines<script>var x="</p>";</script><!-- no --><div class='ad slot'>Buy</div><aside>Aside</aside>
    <ul><li>item<li>other</ul><form><input>Send</form><table><tr><td>cell</td></tr></table>
    <section class="comments"><article class="comment">Nice!</article></section></article></main>
    <div id="sidebar">Side</div><footer>&copy; us</footer></body></html>"""
    assert text_of(page) == "Head & line One bolded word Two lines item other cell"


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<article><p>x", "x"), ("a < b <i>c</i>", "a < b c"), ("<div title='>'>q</div>", "q"), ("<article></article><p>body</p>", "body"), ("<script>x", ""), ("&am &quo &amp", "&am &quo &"), ("<p>one</p></p></div><p>two", "one two")])
def test_odd_markup(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article class="legal"><p>Law of it.</p></article>', "Law of it."),
        ('<article><h2 id="related-work">Related work</h2><p id="social-impact">Impact</p><p class="notice-period">Period</p><div class="ad-hoc">Hoc</div></article>', "Related work Impact Period Hoc"),
        ('<article><p>A</p><div class="related"><a href=x>Other</a> <a href=y>More</a></div><div class="legal">The law says much in many words.</div></article>', "A The law says much in many words."),
        ('<article><p>A</p><div class="share-buttons">Share</div><div class="comment-list">Nice</div><div class="ad">Buy</div></article>', "A Share"),
        ("<main><p>Before</p><article><p>A</p></article><p>After</p><div><a href=x>Links only</a></div></main>", "Before A After"),
        ("<main><p>A</p></main><div class=legal>no</div>", "A"),
        ('<article><p>one <p "two <b>three</b></article>', "one three"),
        ("<article><p>x</p></article><p <p", "x"),
        ("<p>a</p><p title='b>c", "a c"),
    ],
)
def test_names_do_not_decide_alone_inside_articles(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("part", ["<p ", "<p \"", '<p a="<p>" ', "<a", "<script ", "<!", "<!--", "</p ", "<b>", "<p>", "<div></b>", "<b><div></div>", "<p a='", "<p ='\"", "&amp", "<a><article>"])
def test_pages_of_odd_tags_take_linear_time(part):
    import time

    began = time.perf_counter()
    html.blocks(part * (400_000 // len(part)) + "</b>" * 20_000)
    assert time.perf_counter() - began < 10


def test_repeated_doubtful_elements_of_articles_go(spark):
    box = "Sign of the house that stands on each page of it for all to read"
    rows = [(i, "http://h/", f'<article><p>Story {i} told once.</p><div class="notice">{box}</div><div class="notice">Page {i} says {i * 7} and {i * 11} by {i * 13} alone.</div></article>') for i in range(5)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t")).collect()}
    assert got == {i: f"Story {i} told once. Page {i} says {i * 7} and {i * 11} by {i * 13} alone." for i in range(5)}


def brute_repeats(streams):
    """Places of every stretch of LONG tokens that PAGES pages of a host share."""
    seen = {}
    for p, (host, tokens) in enumerate(streams):
        for i in range(len(tokens) - html.LONG + 1):
            seen.setdefault((host, *tokens[i : i + html.LONG]), set()).add(p)
    return seen


def test_suffix_classes_match_brute_force():
    rng = random.Random(1)
    shared = [f"s{i}" for i in range(20)]
    streams = []
    for p in range(40):
        own = [f"w{rng.randrange(6)}" for _ in range(30)]
        own[10:10] = shared[: rng.randrange(21)]
        streams.append((f"h{p % 3}", own))
    place, page, cls = html.repeated_prefixes(streams)
    tokens = [t for _, own in streams for t in own]
    groups = {}
    for at, p, c in zip(place.tolist(), page.tolist(), cls.tolist()):
        groups.setdefault(c, {"key": (streams[p][0], *tokens[at : at + html.LONG]), "pages": set()})["pages"].add(p)
    assert {g["key"]: g["pages"] for g in groups.values()} == brute_repeats(streams)


def test_suffix_array_matches_sorting():
    rng = random.Random(2)
    for n in (0, 1, 2, 50, 400):
        symbols = [rng.randrange(3) for _ in range(n // 2)] * 2
        order, common = html.suffix_array(__import__("numpy").array(symbols, int))
        want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        assert order.tolist() == want
        for a, b, k in zip(want, want[1:], common[1:].tolist()):
            x, y = symbols[a:], symbols[b:]
            assert x[:k] == y[:k] and (len(x) == k or len(y) == k or x[k] != y[k])


def stripped(page):
    """The page without landmark tags, class names, comments and ids: nothing names its boilerplate."""
    page = re.sub(r"<!--.*?-->", "", page)
    return re.sub(r"<(/?)(?:nav|article|footer|ul|li|a)\b[^>]*>", r"<\1div>", re.sub(r'<div class="[^"]*">', "<div>", page))


def test_boilerplate_of_stripped_pages_is_found_by_repetition_alone(spark, sf):
    """Against brute force over all pages of the host, and by precision and recall of the words that should stay."""
    pages = [r for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()]
    frame = spark.createDataFrame([(r.page_id, r.url, stripped(r.html)) for r in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(frame.repartition(5), Scratch(spark, "t")).collect()}
    found = {r.page_id: html.blocks(stripped(r.html)) for r in pages}
    hosts = {r.page_id: html.host_of(r.url) for r in pages}
    seen = brute_repeats([(hosts[p], html.stream(b, 0)[0]) for p, b in found.items()])
    right = kept = total = 0
    for r in pages:
        tokens, owner = html.stream(found[r.page_id], 0)
        hit = [False] * len(tokens)
        for i in range(len(tokens) - html.LONG + 1):
            if len(seen[hosts[r.page_id], *tokens[i : i + html.LONG]]) >= html.PAGES:
                hit[i : i + html.LONG] = [True] * html.LONG
        share = {k: [h for h, o, t in zip(hit, owner, tokens) if o == k and t != "\x00"] for k in range(len(found[r.page_id]))}
        assert got[r.page_id] == " ".join(b.text for k, b in enumerate(found[r.page_id]) if not b.dropped and sum(share[k]) < 0.5 * len(share[k]))
        want, have = plain_article(r.html).split(), got[r.page_id].split()
        both = sum((__import__("collections").Counter(want) & __import__("collections").Counter(have)).values())
        right, kept, total = right + both, kept + len(have), total + len(want)
    print("precision", right / kept, "recall", right / total)
    assert right / kept > 0.92 and right / total > 0.97


def test_repeated_blocks_of_a_host_go_and_unique_ones_stay(spark):
    foot = "All rights of this site belong to its many happy owners and friends"
    rows = [(i, f"http://h{i % 2}/p{i}", f"<div><p>Own story number {i} about thing {i * 7} told here in words for page {i}</p><p>{foot}</p></div>", "x") for i in range(12)]
    rows += [(50, None, None, "x"), (51, None, "", "x"), (52, "http://other/", f"<p>{foot}</p>", "x"), (0, *rows[0][1:]), (None, "http://h0/x", "<article>kept</article>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(frame.repartition(4), Scratch(spark, "t")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[50] == by[51] == "" and by[52] == foot and by[None] == "kept"
    assert all(by[i] == f"Own story number {i} about thing {i * 7} told here in words for page {i}" for i in range(12))
    assert html.extract(frame.limit(0), Scratch(spark, "t")).count() == 0


TEXT = (
    "Mrs Anna Kowalski and Mr. John Smith met Dr Müller; Анна Петрова wrote Bob.Smith42@mail8.example.com and bob.smith42@mail8.example.com, "
    "from 42.144.35.254 and 10.0.0.7, card 4111 1111 1111 1111, +1 (783) 555-5762, 123-45-6789, DE89370400440532013000."
)


def test_surrogates_keep_type_format_script_and_gender():
    new, spans = pii.rewrite(TEXT, pii.Surrogates("key"))
    assert [s[0] for s in spans] == ["name"] * 4 + ["email"] * 2 + ["ip"] * 2 + ["card", "phone", "ssn", "iban"]
    for kind, a, b, _, made in spans:
        old = TEXT[a:b]
        assert old not in new
        if kind == "iban":
            assert re.sub(r"[0-9A-Z]", "x", old[2:]) == re.sub(r"[0-9A-Z]", "x", made[2:])
    assert re.sub(r"\d", "0", new[new.index("card") : new.index(", DE")]) == re.sub(r"\d", "0", TEXT[TEXT.index("card") : TEXT.index(", DE")])
    made = [s[4] for s in spans]
    assert made[0].split()[0] in pii.GIVEN["latin", "f"] and made[1].split()[0] in pii.GIVEN["latin", "m"] and made[3].split()[0] in pii.GIVEN["cyrillic", "f"]
    assert made[4] == made[5] and pii._class_of_ip([*map(int, made[7].split("."))]) == "private"
    assert pii.luhn(made[8]) and pii._iban_number(made[11]) % 97 == 1 and "+1 (" in new
    again, _ = pii.rewrite(TEXT, pii.Surrogates("key"))
    other, _ = pii.rewrite(TEXT, pii.Surrogates("other"))
    assert again == new != other


def test_mentions_of_one_entity_get_one_surrogate():
    made = pii.Surrogates("k")
    text = "Ms Jane Doe, Jane Doe and Doe. Mr Smith came; Smith left. Emily Johnson wrote. Ms Zorine Quill met Zorine. Call 555-123-4567, +1 555-123-4567 or 15551234567. 2001:db8::1 and fe80::1ff:fe23."
    new, spans = pii.rewrite(text, made)
    assert not re.search("Jane|Doe|Smith|Emily|Johnson|Zorine|Quill|4567|db8|fe23", new)
    by = {}
    for kind, a, b, entity, surrogate in spans:
        by.setdefault((kind, entity), set()).add(surrogate)
    assert all(len(x) == 1 for x in by.values())
    assert len(by["phone", "5551234567"]) == 1 and sum(s[0] == "phone" for s in spans) == 3
    full, last = by["name", "Jane Doe"].pop(), by["name", "Doe"].pop()
    assert full.split()[1] == last and full.split()[0] in pii.GIVEN["latin", "f"]
    zorine = by["name", "Zorine"].pop()
    assert zorine.endswith("elia") and by["name", "Zorine Quill"].pop().split()[0] == zorine
    assert new[new.rindex(" and ") + 5 :][:3] in ("fe8", "fe9", "fea", "feb")  # the same kind of address


@pytest.mark.parametrize("text", ["std::vector a::b :: ::1 Foo::Bar", "at 10:30:45 or 1:2", "no. 42345678901 and 999", "DE12 is short", "a@b", "the Doctor said so", "v1.2.3 and 1.2.3.4.5"])
def test_clean_texts_stay(text):
    assert pii.rewrite(text, pii.Surrogates("k")) == (text, [])


def test_surrogates_are_permutations_without_fixed_points():
    made = pii.Surrogates("k")
    numbers = [f"{100 + i % 500:03d}-{i % 90 + 10:02d}-{i % 9000 + 1:04d}" for i in range(3000)]
    assert len({made.ssn(x) for x in numbers}) == len(set(numbers)) and not any(made.ssn(x) == x for x in numbers)
    small = [made.p.string(f"{i:03d}", pii.DIGITS, "t") for i in range(1000)]
    assert len(set(small)) == 1000 and not any(int(x) == i for i, x in enumerate(small))
    assert len({made.email(f"a{i}@b{i % 3}.com") for i in range(500)}) == 500
    for names in pii.GIVEN.values():
        assert {made.name(n, "given") for n in names} == set(names) and not any(made.name(n, "given") == n for n in names)
    assert not any(n.endswith(tuple(pii.ENDINGS.values())) for n in pii._ALL_GIVEN)
    assert len({made.ip(f"2001:db8::{i:x}") for i in range(300)}) == 300
    assert len({made.phone(f"+49 170 {i:03d} 4455") for i in range(300)}) == 300


@pytest.mark.parametrize("letters", ["ابتثجحخدذرزسشص", "абвгдежзий", "αβγδεζηθικ", "אבגדהוזחטי", "éèàüöäñçøå", "abcdefghij", "あいうえおかきくけこ"])
def test_surnames_of_any_script_stay_distinct_and_none_stays(letters):
    import itertools

    made = pii.Surrogates("k")
    for role in ("surname", "f", "m"):
        names = ["".join(x).capitalize() for x in itertools.product(letters, repeat=3)]
        new = [made.word(n, role) for n in names]
        assert len(set(new)) == len(names) and not any(a == b for a, b in zip(names, new))
        assert all(n[0].isupper() == m[0].isupper() for n, m in zip(names, new))


def test_names_of_all_roles_share_no_surrogate():
    import itertools

    made = pii.Surrogates("k")
    names = ["".join(x).capitalize() for n in (2, 3) for x in itertools.product("aonmei", repeat=n)]
    names += [n + e for n in ("Med", "Bo") for (script, _), e in pii.ENDINGS.items() if script == "latin"]
    new = {(n, r): made.name(n, "surname" if r == "surname" else "given", "" if r == "surname" else r) for n in names for r in ("surname", "f", "m") if n not in pii._ALL_GIVEN}
    new |= {(n, ""): made.name(n, "surname") for n in pii._ALL_GIVEN}
    given = [v for (n, r), v in new.items() if r != ""]
    assert len(set(new.values())) == len(new) and not set(given) & set(pii._ALL_GIVEN)


def test_rewriting_a_table(spark, sf):
    rows = [(1, TEXT, "x"), (1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (None, "mail a.b@c.example.com", "x"), (5, "word " * 50000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.surrogates(frame, "key")
    got = out.collect()
    assert len(got) == 6 and sorted(len(r.spans) for r in got) == [0, 0, 0, 1, 12, 12]
    assert pii.collisions(out).count() == 0 and pii.surrogates(frame.limit(0), "key").count() == 0


def test_query_keeps_distinctness_and_coreference_over_all_rows(spark, sf):
    """Against brute force over all documents: every mention of an entity, and only of it, has its surrogate; the rest of each text stays."""
    big = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    done = pii.surrogates(docs, "production-key-from-the-caller")
    assert pii.collisions(done).count() == 0 and pii.split_entities(done).count() == 0
    old = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r for r in queries.op5_pii_surrogates(spark, big).collect()}
    entity, surrogate = {}, {}
    for r in done.collect():
        text, at, rest = old[r.doc_id] or "", 0, []
        for s in r.spans:
            assert entity.setdefault((s.kind, s.entity), s.surrogate) == s.surrogate and surrogate.setdefault((s.kind, s.surrogate), s.entity) == s.entity
            assert s.entity != s.surrogate and s.start >= at
            rest.append(re.escape(text[at : s.start]))
            at = s.end
        assert re.fullmatch(r"[^\n]+?".join([*rest, re.escape(text[at:])]), r.text, re.S) and rows[r.doc_id].text == r.text
        assert sum(rows[r.doc_id][f"n_{k}"] for k in pii.KINDS) == len(r.spans)
    assert len(entity) > 50 and set(rows) == set(old)


def test_license_query_matches_sql(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{big}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, whole_license, licenses, n_lines, n_blocks FROM ({licenses.oracle()})").fetchall())
    got = sorted(tuple(r) for r in queries.op3_license_scan(spark, big).select("doc_id", "whole_license", "licenses", "n_lines", "n_blocks").collect())
    assert got == want and sum(r[3] for r in got) > 0


def test_license_cases(spark):
    mit = "MIT License " + dict(reversed(licenses.whole_texts()))["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + mit.replace(". ", ".\n"), "x"), (2, "story\nreleased under the mit LICENCE!\nend", "x"), (3, "# Licensed under the Apache License v2.0\nLicensed under CC BY-NC 4.0.", "x"),
        (4, None, "x"), (5, "", "x"), (6, "a license plate", "x"), (7, "SPDX-License-Identifier: GPL-3.0", "x"), (None, "MIT License", "x"), (2, "none", "x"), (8, "word " * 90000, "x"),
    ]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string"), Scratch(spark, "t")).collect()
    by = {r.doc_id: r for r in got}
    assert sorted(r.licenses for r in got if r.doc_id == 2) == ["", "MIT"]  # each row its own
    assert len(got) == len(rows) and by[1].whole_license == "MIT" and by[3].licenses == "Apache-2.0,CC-BY-NC-4.0" and by[3].n_lines == 2
    assert by[4].licenses == by[5].licenses == by[6].licenses == by[8].licenses == "" and by[7].licenses == by[7].whole_license == "GPL-3.0"
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).count() == 0
    assert all(re.search(licenses.WORDS, t) for _, t in licenses.known_texts())


def test_whole_texts_are_found_alone_and_inside_files(spark):
    texts = licenses.whole_texts()
    names = sorted({i for i, _ in texts})
    rows, want = [], {}
    for k, name in enumerate(names):
        body = next(t for i, t in texts if i == name)
        words = body.split()
        wrapped = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)).upper()
        half = len(words) // 2
        commented = "\n".join(["#!/bin/sh", "# a tool", "#", "# Copyright (c) 2001-2024, Someone", "# All rights reserved.", "#", "# " + " ".join(words[:half]), "#", "# " + " ".join(words[half:]), "#", "", "run --fast"])
        rows += [(10 * k, f"{licenses.LICENSES[name][0]}\n\nCopyright 2020 Someone\n\n{wrapped}"), (10 * k + 1, commented), (10 * k + 2, body + " and one more word")]
        want |= {10 * k: (name, name), 10 * k + 1: (None, name), 10 * k + 2: (None, "")}
    got = {r.doc_id: (r.whole_license, r.licenses) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert got == want
    more = spark.createDataFrame([("Own-1.0", "The own software terms: be kind.")], "license string, text string")
    frame = spark.createDataFrame([(1, "the OWN software terms; be kind"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.whole_license for r in licenses.license_scan(frame, Scratch(spark, "t"), more).collect()} == {1: "Own-1.0", 2: None}


def test_rows_keep_their_own_licences_and_long_texts_are_found_in_files(spark):
    rows = [(1, "Licensed under the MIT License"), (1, "nothing"), (None, "Licensed under the MIT License"), (None, "x"), (1, "Licensed under the MIT License")]
    got = sorted((str(r.doc_id), str(r.whole_license)) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect())
    assert got == [("1", "MIT"), ("1", "MIT"), ("1", "None"), ("None", "MIT"), ("None", "None")]
    paragraphs = [f"Article {k} of the long terms, part {k * 7}: be kind to all in case {k}." for k in range(2500)]
    more = spark.createDataFrame([("Long-1.0", "\n\n".join(paragraphs)), (None, "no licence named"), ("Null", None)], "license string, text string")
    docs = [(1, "A tool.\n\n" + "\n\n".join(paragraphs) + "\n\ncode"), (2, "\n\n".join(paragraphs[:-1])), (3, "\n\n".join(paragraphs)), (4, "x\n\n" + " \n ".join(paragraphs) + "\n\ny")]
    got = {r.doc_id: (r.whole_license, r.licenses, r.n_blocks) for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "t"), more).collect()}
    assert got == {1: (None, "Long-1.0", 1), 2: (None, "", 0), 3: ("Long-1.0", "Long-1.0", 1), 4: (None, "Long-1.0", 1)}
