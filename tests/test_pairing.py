import random

from papercairn.operators import joins


def _brute(rows, cols, banned):
    used_p, used_q, out = set(), set(), []
    for s, i, j in sorted((-s, p["pos"], q["pos"]) for p in rows for q in cols if (s := joins._reference_score(p, q, banned)) > 0):
        if i not in used_p and j not in used_q:
            used_p.add(i)
            used_q.add(j)
            out.append((i, j, -s))
    return out


def test_pairs_as_by_all_scores():
    """What is left out before scoring changes no pair: DOIs, equal and like titles, printed texts, positions given twice."""
    draw = random.Random(5)
    words = "light graft skin knee adult trial scar edge pain sweat laser margin elbow vessel report results".split()
    for n in range(150):
        title = lambda: None if draw.random() < 0.1 else " ".join(draw.choice(words) for _ in range(draw.choice((1, 3, 4))))
        change = lambda t: t and (t.upper() if draw.random() < 0.4 else " ".join(draw.sample(t.split(), len(t.split()))) if draw.random() < 0.4 else t[: -draw.randint(1, 4)])
        cols = [{"pos": draw.randint(1, 14) if n % 5 == 0 else i, "title": title(), "year": draw.choice((None, 2000, 2001, 2003)), "doi": draw.choice((None, "10.1/a", "10.1/b", "10.1/c")), "author": draw.choice((None, "Doe", "Roe")), "journal": draw.choice((None, "Skin", "Hair"))} for i in range(draw.randint(0, 14))]
        rows = []
        for i in range(draw.randint(0, 14)):
            q = draw.choice(cols) if cols and draw.random() < 0.7 else {"title": title(), "year": 2002, "doi": None, "author": "Poe", "journal": "Nail"}
            kind = draw.random()
            raw = "" if kind < 0.3 else f"{q['author']} J. {q['title']}. {q['journal']} {q['year']}; 3: 4-9"
            rows.append({"pos": draw.randint(1, 14) if n % 7 == 0 else i, "title": change(q["title"]) if kind < 0.6 else None, "year": q["year"] and q["year"] + draw.choice((0, 0, 1, 2)), "doi": q["doi"] if draw.random() < 0.3 else None, "raw": raw})
        for banned in (set(), {"10.1/a"}):
            assert joins.one_to_one(rows, cols, banned) == _brute(rows, cols, banned), n


def test_long_lists_score_few_pairs(monkeypatch):
    """Lists of equal titles aren't scored pair by pair."""
    draw = random.Random(1)
    scored = []
    monkeypatch.setattr(joins, "_reference_score", lambda p, q, banned, own=joins._reference_score: scored.append(1) or own(p, q, banned))
    titles = [" ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)) for _ in range(800)]
    rows = [{"pos": i, "title": t, "year": 1990 + i % 30, "doi": None, "raw": ""} for i, t in enumerate(titles)]
    cols = [{"pos": 2000 - i, "title": t.upper(), "year": 1990 + i % 30, "doi": "10.1/x", "author": None, "journal": None} for i, t in enumerate(titles) if i % 3]
    cols.append({"pos": 5000, "title": titles[0][:-2], "year": 1990, "doi": None, "author": None, "journal": None})
    got = joins.one_to_one(rows, cols, set())
    assert len(got) == len(cols) and got[-1][:2] == (0, 5000) and len(scored) < 1000


def test_merged_once(spark):
    printed = spark.createDataFrame([("p", 1, "A title of some length", 2001, None, ""), (None, 1, "A title of some length", 2001, None, "")], "paper_id string, pos int, title string, year int, doi string, raw string")
    items = spark.createDataFrame([("p", 7, "A title of some length", 2001, "10.1/a", None, None), ("p", 8, "Only listed here", 2002, None, None, None), (None, 7, "A title of some length", 2001, "10.1/a", None, None)], "paper_id string, pos int, title string, year int, doi string, author string, journal string")
    got = joins.merged_references(printed, items)
    assert got._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInPandas") <= 1
    assert sorted([(r["paper_id"] or "", r["pos"] or 0, r["title"], r["doi"], r["source"]) for r in got.collect()]) == [("", 0, "A title of some length", "10.1/a", "listed"), ("", 1, "A title of some length", None, "parsed"), ("p", 0, "Only listed here", None, "listed"), ("p", 1, "A title of some length", "10.1/a", "parsed+listed")]
