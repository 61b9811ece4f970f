"""Extraction, phrases and conversation repair against brute force, and on odd tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tremolite.llm import phrases, queries, repair, sql, templates

SF = "/root/testdata/sf0.01"

# Conversation repair

TURNS = "conv_id long, turn long, role string, text string"


def brute_repair(rows):
    """The repair of (turn, role, text) rows in order: the cheapest first, of equal ones the least audit, by search."""
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults, seen = [], set()
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    prefix = re.compile(r"s?(ua)*u?\Z")
    todo, done = [(0, "", 0, ())], set()
    while True:
        cost, audit, at, out = heapq.heappop(todo)
        said = "".join(r[:1] for r, _ in out)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", said):
            break
        # what may follow depends on these alone; the first to come is the least
        if (state := (at, len(said) > 0 and (said[-1], said == "s"))) in done:
            continue
        done.add(state)
        edits = [(3, "I", role, "", 0) for role in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            more = 3 * (faults[at] == "truncated")
            if faults[at] not in ("blank", "duplicate"):
                edits += [(more, "K", role, text, 1), (3 + more, "R", "user", text, 1), (3 + more, "R", "assistant", text, 1)]
            heapq.heappush(todo, (cost + 4, audit + "D", at + 1, out))
        for extra, letter, role, text, step in edits:
            if role and prefix.match(said + role[:1]):
                heapq.heappush(todo, (cost + extra, audit + letter, at + step, (*out, (role, text))))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def brute_report(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        convs[conv] += []
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            convs[conv] += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return {c: brute_repair(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))) for c, r in convs.items()}


def random_turns(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "well", "", " \t", "Yes. \n", "so\x0b", "Ω.", "!", None]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "unknown", None, "s"]
    return [(rng.choice([None, *range(n // 6 + 1)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def reported(df):
    return {r.conv_id: tuple(r[c.split()[0]] for c in repair.REPORT.split(", ")) for r in df.collect()}


@pytest.mark.parametrize("piece_rows", [1, 2, 5, repair.PIECE_ROWS])
def test_repair_is_brute_force_whatever_the_pieces(spark, piece_rows):
    rows = random_turns(400, 7)
    df = spark.createDataFrame(rows, TURNS)
    assert reported(repair.repair_structure(repair.damaged(df), df, piece_rows)) == brute_report(rows)


def test_one_long_conversation_is_shared_by_tasks(spark):
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "Hm?", ""]) + f" {t % 97}.") for t in range(3000)] + [(6, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, TURNS).repartition(8)
    assert reported(repair.repair_structure(repair.damaged(df), df, 100)) == brute_report(rows)


def test_repair_of_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert reported(repair.repair_report(empty)) == {}
    nothing = hashlib.sha256(b"").hexdigest()
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    long = ("wörd " * 200_000) + "."
    rows = [(gone, 0, "user", "Hi."), (-1, 1, "", "No role."), (-1, 2, "user", long), (-1, 2, "user", long), (-1, 3, "assistant", "Ok.")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "text AS fault", "turn AS n", "role AS said", "conv_id AS piece", "conv_id AS how")
    got = reported(repair.repair_report(df))
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got == brute_report(rows)


def test_repair_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reported(queries.op13_repair_structure(spark, SF)) == brute_report(rows)


def test_repair_sql_on_odd_rows(spark):
    rows = random_turns(300, 11)
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, TURNS).toArrow())
    found = con.execute(sql.ORACLES["op13_repair_structure"])
    names = [d[0] for d in found.description]
    got = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert {r["conv_id"]: tuple(r[c.split()[0]] for c in repair.REPORT.split(", ")) for r in got} == brute_report(rows)


# Phrases


def brute_collocations(rows, top, longest, least):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "a", "a", "Ärger", "x y", "ok!", "end.", "tab\tbed", "#", "l\nm", "\x1cq"]
    return [(" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(60))) if rng.random() < 0.95 else None, rng.choice(["en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("sent_rows", [0, 10, phrases.SENT_ROWS])
def test_phrases_are_brute_force_however_ids_reach_tasks(spark, sent_rows):
    rows = random_texts(300, 5)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = phrases.collocations(df, top=40, longest=4, least=6, sent_rows=sent_rows)
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows, 40, 4, 6)


def test_ids_of_many_chunks_are_never_collected(spark, monkeypatch):
    """What a join finds for the chunks reaches a task chunk by chunk, however many there are."""
    plans, real = [], phrases.staged
    monkeypatch.setattr(phrases, "staged", lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, label))
    df = spark.createDataFrame([(n, t, lang) for n, (t, lang) in enumerate(random_texts(60, 5))], "doc_id long, text string, lang string")
    phrases.frequent_phrases(df, longest=3, least=6, sent_rows=0)
    of_chunks = [p for label, p in plans if label in ("chunks", "spelt")]
    assert of_chunks and any("CoGroup" in p for p in of_chunks), "ids aren't joined"
    assert not any("collect_list" in p or "array<" in p for p in of_chunks)


def test_pairs_are_sent_by_their_size(spark):
    """A pair takes a twelfth of what a word takes, so that pairs are joined with the text only where they are very many."""
    pairs = spark.range(20).selectExpr("'en' AS lang", "CAST(id AS int) AS i", "CAST(id AS int) AS j", "CAST(id AS int) AS id")
    chunks = spark.createDataFrame([], phrases.CHUNK)
    seen, real = [], phrases._sent
    phrases._sent = lambda *a: seen.append(real(*a)) or seen[-1]
    try:
        assert phrases.extend(chunks, pairs, 1, sent_rows=4).count() == 0 and phrases.extend(chunks, pairs, 1, sent_rows=2).count() == 0
    finally:
        phrases._sent = real
    assert seen[0] is not None and seen[0].value["en"][1].tolist() == list(range(20)) and seen[1] is None


def test_tiles_count_as_a_counter_does():
    rng = np.random.default_rng(1)
    i, j = (rng.zipf(1.3, 400_000) % 3000 for _ in range(2))
    codes = phrases._code(i, j)
    got, n = phrases.tile_counts(codes)
    assert (np.bincount((i // phrases.TILE) * 8 + j // phrases.TILE) >= phrases.TILE**2 // phrases.DENSE).any(), "no tile is dense"
    assert dict(zip(got.tolist(), n.tolist(), strict=True)) == Counter(codes.tolist())
    assert len(phrases.tile_counts(codes[:0])[0]) == 0


def test_phrases_of_odd_tables(spark):
    schema = "text string, lang string, n long, id long, word string, chunk long, total long"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None, 1, 1, "a", 1, 1), ("", "en", 1, 1, "a", 1, 1)], schema)).collect() == []
    rows = [("ab cd " * 50_000, None)] + [("x y. x y", "en")] * 60
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], schema)
    assert {tuple(r) for r in phrases.collocations(df).collect()} == brute_collocations(rows, 2000, 5, 100)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4 * 10**12
    levels = [spark.createDataFrame([("en", "a b", big, [big + 1], [big + 3])], "lang string, phrase string, n long, firsts array<long>, rests array<long>")]
    totals = spark.createDataFrame([("en", 10**14 + 7)], "lang string, total long")
    real = phrases.frequent_phrases
    phrases.frequent_phrases = lambda *a: (totals, [None, *levels])
    try:
        row = phrases.collocations(None).first()
    finally:
        phrases.frequent_phrases = real
    assert row.score == 1000 * big * (10**14 + 7) // ((big + 1) * (big + 3))


# Pages

PAGES = "page_id long, url string, html string"


def texts_of(df):
    return {r.page_id: r.text for r in templates.extract_text(df).collect()}


def test_article_of_a_page_with_all_that_is_apart(spark):
    source = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Top</header><nav><ul><li>A<li>B</ul></nav>
        <div class="cookie-notice">We use cookies</div><script>var t="</p><article>no</article>";</script><!-- <p>hidden</p> -->
        <article><h1>Caf&eacute;&nbsp;&amp; bar</h1><p>One <b>two<br>three</b>
          four<p>a &lt; b &#8212; c<div class="ad">Buy</div><ul><li>first<li>sec<i>ond</i></ul><form>Name <input></form><b><p>in</b> side</p>
          <aside>More</aside><blockquote>said</blockquote><table><tr><td>x<td>y</table><p hidden>5 < 6 &unknown;</p>
          <section id="comments"><article class="comment"><p>Nice!</p></article></section></article>
        <footer>&copy; us</footer></body></html>"""
    df = spark.createDataFrame([(1, "https://one.example/x", source)], PAGES)
    assert texts_of(df)[1].split("\n\n") == ["Café & bar", "One two three four", "a < b — c", "first", "second", "in side", "said", "x", "y", "5 < 6 &unknown;"]


def skeleton(n, body, menu="Home"):
    return f"<html><body><div id='top'>{menu}</div><div class='box'><div class='text'>{body}</div><div class='low'>All rights reserved</div></div><p>{n % 3}</p></body></html>"


def test_template_finds_the_text_where_no_element_says_so(spark):
    said = {n: "".join(f"<p>Paragraph {n} {k} of some length</p>" for k in range(1 + n % 4)) + "<p>Sent to you by us</p>" for n in range(20)}
    rows = [(n, f"http://Many.example/{n}?q=/x", skeleton(n, said[n])) for n in range(20)]
    found = templates.deduce_templates(spark.createDataFrame(rows, PAGES)).collect()
    assert [(r.host, r.pages, r.main) for r in found] == [("many.example", 20, "/html/body/div.box/div.text")]
    root = next(c for c in found[0].classes if c.on == 20 and c.parent == -1)
    assert len(root.tokens) >= 13, "the skeleton is one class"
    inner = [c for c in found[0].classes if c.parent == root["class"]]
    assert inner, "paragraphs are a class in one of its slots"
    assert texts_of(spark.createDataFrame(rows, PAGES)) == {n: "\n\n".join(f"Paragraph {n} {k} of some length" for k in range(1 + n % 4)) for n in range(20)}


def test_classes_out_of_order_are_no_template(spark):
    bodies = ["<h2>a{0}</h2><section>b{0}</section>", "<section>b{0}</section><h2>a{0}</h2>"]
    rows = [(n, "http://odd.example/", f"<html><body>{bodies[n % 2].format(n)}</body></html>") for n in range(8)]
    (found,) = templates.deduce_templates(spark.createDataFrame(rows, PAGES)).collect()
    mixed = {templates._token("<", "/html/body/h2"), templates._token("<", "/html/body/section")}
    assert not any(mixed & set(c.tokens) for c in found.classes)


def test_pages_of_odd_tables(spark):
    assert templates.extract_text(spark.createDataFrame([], PAGES)).collect() == []
    deep = "<div>" * 3000 + "deep" + "</div>" * 10
    rows = [(1, None, None), (2, "http://a.example", ""), (3, "http://a.example", "no tags"), (3, "http://a.example", "no tags"), (4, "x", "<p>" + "word " * 200_000), (None, "http://a.example", "<article>t"), (5, "http://b.example", deep), (6, "http://b.example", "<p>a<!-- never closed <p>b"), (7, "", "</p></div><p>c</p><a href='x>d</a>")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "html AS host", "html AS text", "page_id AS n_chars", "url AS main", "url AS own")
    got = templates.extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = [(r.page_id, r.text) for r in got.collect()]
    assert sorted(found, key=str) == sorted([(1, ""), (2, ""), (3, "no tags"), (3, "no tags"), (4, "word " * 199_999 + "word"), (None, "t"), (5, "deep"), (6, "a"), (7, "c\n\nd")], key=str)


def test_whole_pages_table_is_its_articles(spark):
    got = {r.page_id: r for r in queries.op11_extract_text(spark, SF).collect()}
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", article))
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].url, got[r.page_id].n_chars) == (r.url, len(got[r.page_id].text))
