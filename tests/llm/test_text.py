import random

from papercairn.llm import encoding, scans, sentences
from pyspark.sql import functions as F

EN = [
    "Dr. A. Stone graded the sole on day 5 (κ = 0.54), and the face matched the knee.",
    "“Does the sole itch at night?” was asked of 12 women, and 5% said that it did.",
    "Stone et al. reported that the cream reduced the fold in approx. 40% of men, i.e. since it was broad.",
    "Mean area went from 5.53 to 10.82 on the hands (P = 0.0396), although the knee reversed it.",
    "As shown in Fig. 3 and Table 1, the light tracked the fold (cream vs. light, 3.2–4.5).",
    "Other care (light alone, cream, etc.) preceded the fold by 3.5% on the trunk.[12]",
    "Serum levels were 3.5 µg/L at baseline and 4.5 µg/L at week 4 in late men.",
    "Überall war die Läsion größer.",
]


def paragraphs(n, seed=0):
    r = random.Random(seed)
    return [" ".join(r.choice(EN[:7]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def test_sentences_on_held_out_paragraphs(spark):
    corpus = spark.createDataFrame([(t,) for t in paragraphs(800)] + [(None,), ("",), (" \n",)], "text string")
    model = sentences.train(corpus)
    r = random.Random(9)
    right = total = 0
    for _ in range(200):
        parts = [r.choice(EN[:7]) for _ in range(r.randint(1, 5))]
        want, at = [], 0
        for p in parts:
            at += len(p)
            want.append(at)
            at += 1
        got = model.ends(" ".join(parts))
        right += len(set(got) & set(want))
        total += max(len(got), len(want))
    assert right / total > 0.98
    assert model.ends("") == model.ends(" \n") == []
    assert model.ends("no end mark ") == [11]
    rows = [("a", EN[0] + " " + EN[5], 1), ("a", EN[0] + " " + EN[5], 2), ("n", None, 1), ("b", " ", 1), ("long", "x" * 200_000, 1), (None, "One.", 1)]
    got = sentences.sentences(spark.createDataFrame(rows, "id string, text string, sentence int"), model).toPandas()
    assert sorted(got.id.fillna("null")) == ["a", "a", "long", "null"]
    assert list(got[got.id == "a"].end) == [len(EN[0]), len(EN[0]) + 1 + len(EN[5])]
    assert all(t == t.strip() for t in got.text)
    empty = sentences.train(corpus.filter("false"))
    assert empty.ends("A b. C d.")[-1] == 9


#: Sentences of several scripts, set down by hand: each text with the parts it is made of.
GOLD = [
    ["皮损的面积逐渐缩小。", "停药后是否复发？", "未见复发！"],
    ["病変は縮小した。", "「痛みはどうか。」と尋ねた。", "変化はなかった。"],
    ["Лечение началось в мае. ", "Боль прошла через 3,5 дня."],
    ["هل تحسنت الحالة؟ ", "نعم، تحسنت كثيرا."],
    ["क्या दर्द कम हुआ? ", "हाँ, बहुत कम हुआ।"],
    ["The dose was 3.5 mg. ", "It helped (see p. 4). ", "No pain was felt.[12] ", "Was it due to the cream?"],
    ["Die Fläche war z. B. am Fuß kleiner. ", "Danach blieb sie gleich."],
]


def test_sentences_of_many_scripts(spark):
    r = random.Random(3)
    corpus = paragraphs(400)
    for parts in GOLD:
        # Paragraphs of the language, one to three sentences each
        corpus += ["".join(r.choice(parts) for _ in range(r.randint(1, 3))).strip() for _ in range(150)]
    model = sentences.train(spark.createDataFrame([(t,) for t in corpus], "text string"))
    right = total = 0
    for parts in GOLD:
        text, want = "", []
        for p in parts:
            text += p
            want.append(len(text.rstrip()))
        got = model.ends(text)
        right += len(set(got) & set(want))
        total += max(len(got), len(want))
    assert right >= 0.9 * total


DAMAGE = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("utf-8", "gbk"), ("cp1252", "mac_roman")]


def test_restoring_undoes_damage(spark):
    r = random.Random(5)
    clean = paragraphs(3000) + [f"Die Läsion war größer und über {i} Tage später rückläufig, z. B. am Fuß für {i} Jahre." for i in range(400)]
    damaged = []
    for i in range(36):
        t = r.choice(clean[3000:])
        wrote, read = DAMAGE[i % len(DAMAGE)]
        try:
            damaged.append((f"d{i}", t, t.encode(wrote).decode(read)))
        except UnicodeError:
            continue
    twice = clean[3100].encode().decode("latin-1").encode().decode("latin-1")
    rows = [("t", f"c{i}", t, 1) for i, t in enumerate(clean)] + [("t", k, bad, 1) for k, _, bad in damaged] + [("t", "twice", twice, 1), ("t", "lost", "Serum Gr��n was high.", 1), ("t", "lost", "Serum Gr��n was high.", 1), ("t", "null", None, 1), ("t", "blank", " ", 1), (None, None, "long κ " * 30_000, 1)]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string, steps int")
    got = {x["rec_id"]: x for x in encoding.restored(df, df.select("text")).collect()}
    assert not [k for k in got if k and k.startswith("c")]
    assert "lost" in got and got["lost"]["steps"] == 0
    assert len(damaged) > 30
    assert sum(k in got for k, _, _ in damaged) >= 0.95 * len(damaged)
    assert sum(k in got and got[k]["restored"] == t for k, t, _ in damaged) >= 0.9 * len(damaged)
    assert got["twice"]["restored"] == clean[3100]
    assert encoding.restored(df.filter("false"), df.select("text").filter("false")).count() == 0


def test_frequent_damage_is_found(spark):
    """A tenth of all texts decoded wrongly in one way."""
    r = random.Random(8)
    german = [f"Die Läsion {i} war größer als {r.randint(2, 99)} mm und über {r.randint(2, 99)} Tage rückläufig, häufig am Fuß." for i in range(600)]
    chinese = [f"治疗前面部皮损的面积为{r.randint(2, 99)},停药后{i}例患者的质量逐渐改" for i in range(600)]
    clean = paragraphs(1200) + german + chinese
    bad = {("g", i): (t, t.encode("cp1252").decode("mac_roman")) for i, t in enumerate(german[:150])}
    bad |= {("z", i): (t, t.encode("gbk").decode("cp949")) for i, t in enumerate(chinese[:150])}
    rows = [("t", f"c{i}", t) for i, t in enumerate(clean)] + [("t", f"{k}{i}", b) for (k, i), (_, b) in bad.items()]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string")
    got = {x["rec_id"]: x["restored"] for x in encoding.restored(df, df.select("text")).collect()}
    assert not [k for k in got if k.startswith("c")]
    for kind in "gz":
        mine = [(f"{k}{i}", t) for (k, i), (t, _) in bad.items() if k == kind]
        assert sum(k in got for k, _ in mine) >= 0.95 * len(mine), kind
        assert sum(got.get(k) == t for k, t in mine) >= 0.9 * len(mine), kind


def test_words_and_models_are_counted_over_all_texts(spark):
    """Nine thousand texts, of which seven have a name; a text delivered again is the same text."""
    rows = [f"The fold {i} was broad in the light." for i in range(9000)] + [f"Dr. Žilkuvar saw {i} of them." for i in range(7)]
    n, found = encoding.counted(spark.createDataFrame([(t,) for t in [*rows, rows[-1]]], "t string"))
    assert (n, found["Žilkuvar"], found["Ž"]) == (9007, 7, 7)

    whole, made = encoding.Model(), []
    whole.add(rows)
    for some in (rows[:4000], rows[4000:]):
        part = encoding.Model()
        part.add(some)
        made += list(encoding.parts("en", part))
    table, alphabet, total = encoding.models(spark.createDataFrame(made, encoding._PARTS))["en"]
    assert set(alphabet) == set("".join(rows[:10])) and abs(total - whole.fitted()[2]) < 10
    # Only the runs across the place where the parts meet differ
    assert abs(table - whole.table).sum() < 50


def test_languages_described_together_or_alone():
    models = {}
    for name, texts in {"en": EN, "de": EN[7:], "fr": EN[:2], "es": EN[3:5], "it": EN[5:]}.items():
        m = encoding.Model()
        m.add(texts)
        models[name] = m.fitted()
    r = encoding.Restorer({}, 9, models, {})
    for t in (EN[0], EN[7], "a\x96b \ufffd", "κ"):
        whole = r.each(t)
        assert all(abs(r.each(t, [n])[n] - bits) < 0.01 for n, bits in whole.items()) and len(whole) == 5
    assert r.each(EN[7])["de"] < r.each(EN[7])["fr"]


def test_candidates_are_described_together(monkeypatch):
    """A text has many candidates; they are looked up at once, and as long as each of them alone."""
    models = {}
    german = [f"Die Läsion {i} war größer als früher und über {i} Tage rückläufig, häufig am Fuß." for i in range(40)]
    for name, texts in {"en": EN, "de": german, "fr": EN[:2]}.items():
        m = encoding.Model()
        m.add(texts)
        models[name] = m.fitted()
    found = encoding.Counter(u for t in german for u in encoding.units(t))
    r = encoding.Restorer({c: n for c, n in found.items() if len(c) == 1}, 60, models, found)
    bad = german[3].encode("cp1252").decode("mac_roman")
    candidates = r.steps(bad)
    assert german[3] in candidates and len(candidates) > 5
    log2, calls = encoding.np.log2, []
    monkeypatch.setattr(encoding.np, "log2", lambda *x: calls.append(1) or log2(*x))
    assert r.restore(bad) == (german[3], 1, True)
    assert len(calls) <= 2 + 3 * 4  # the text once, then a step at a time by four languages at most
    pieces = [(t, names) for t in [*candidates, EN[0], "a\x96b \ufffd", "κ", "7·5"] for names in (("de",), ("de", "en", "fr"))]
    r.lengths.clear()
    r.describe(pieces)
    assert all(abs(r.lengths[t, names] - min(r.each(t, names).values())) < 0.01 for t, names in pieces)


RU = ["Лечение началось в мае и длилось три недели.", "Боль в колене прошла через несколько дней.", "Площадь пятна уменьшилась после мази."]
EL = ["Η θεραπεία άρχισε τον Μάιο και κράτησε τρεις εβδομάδες.", "Ο πόνος στο γόνατο πέρασε μετά από λίγες μέρες.", "Η έκταση της κηλίδας μειώθηκε μετά την αλοιφή."]
PL = ["Leczenie zaczęło się w maju i trwało trzy tygodnie, później ból ustąpił.", "Powierzchnia zmiany zmniejszyła się po maści, a świąd minął."]


def test_other_scripts_read_in_the_wrong_set(spark):
    r = random.Random(4)
    mixed = lambda parts: " ".join(r.choice(parts) for _ in range(r.randint(2, 4)))
    clean = [mixed(EN[:7]) for _ in range(300)] + [mixed(x) for x in (RU, EL, PL) for _ in range(150)]
    bad = {}
    for k, (parts, wrote, read) in {"win": (RU, "cp1251", "cp1252"), "koi": (RU, "koi8_r", "cp1252"), "dos": (RU, "cp866", "cp1252"), "gr": (EL, "cp1253", "cp1252"), "iso": (EL, "iso8859_7", "cp1252"), "pl": (PL, "cp1250", "cp1252")}.items():
        t = mixed(parts)
        bad[k] = t, t.encode(wrote).decode(read, "replace") if k != "dos" else "".join(chr(b) if b < 128 else bytes([b]).decode("cp1252", "replace") for b in t.encode(wrote))
    rows = [("t", f"c{i}", t) for i, t in enumerate(clean)] + [("t", k, b) for k, (_, b) in bad.items()] + [("t", "private", "the " + chr(0xF062) + "-blocker"), ("t", "cid", "the (cid:12) fold")]
    # Words without any right reading stay as they are
    rows += [("t", "c-name", "Ållstrup and Žilkuvar saw Çelbekur and Nguyễn.")]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string")
    got = {x["rec_id"]: x["restored"] for x in encoding.restored(df, df.select("text")).collect()}
    assert not [k for k in got if k.startswith("c") and k != "cid"]
    assert got["private"] == "the β-blocker" and "cid" in got
    for k in ("win", "koi", "gr", "iso", "pl"):
        assert got.get(k) == bad[k][0], (k, got.get(k), bad[k])


def test_scans(spark):
    r = random.Random(2)
    words = "the fold reduced cheek margin temple lesion broad sunlit truncal border narrow reservoir cluster patient responder baseline and was with nerve infiltrate ending matched self parent rated".split()
    lines = [" ".join(r.choice(words) for _ in range(60)) + "." for _ in range(900)]
    rows = [("p", f"c{i}", t, False, 1) for i, t in enumerate(lines)]
    wrapped = lines[0][:60].rsplit(" ", 1)[0]
    rows += [
        ("p", "wrap", lines[1].replace(" ", "\n", 9), False, 1),
        ("p", "hyphen", "the reser-\nvoir matched the nerve", False, 1),
        ("p", "compound", "self-\nand parent-\nrated fold", False, 1),
        ("p", "misread", "the rnargin of the ternple was narr0w and the @nd", False, 1),
        ("p", "page", f"{wrapped}\n— 278 —\nand the fold matched the nerve ending", False, 1),
        ("p", "header", f"{wrapped}\nCutis Quarterly Review, Vol. 3, No. 2\nand the fold matched", False, 1),
        ("t", "table", "| Item | Broad border |\n| --- | --- | --- |\n| Narrow reser-<br>voir | 3 | 4S.2 |\n| Sunlit ternple | 1 | 2 |", True, 1),
        ("p", "hyphen", "the reser-\nvoir matched the nerve", False, 1),
        ("p", "torn", "the pati ent with the respon der andnarrow reservoir", False, 1),
        ("p", "null", None, False, 1),
        ("p", "blank", " \n ", None, 1),
        ("p", "long", "the fold " * 40_000, False, 1),
        (None, None, "x", None, 1),
    ]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string, is_table boolean, hyphens int")
    got = {x["rec_id"]: x for x in scans.repaired(df).collect()}
    assert set(got) == {"hyphen", "misread", "page", "header", "table", "torn"}
    assert got["torn"]["text"] == "the patient with the responder and narrow reservoir" and got["torn"]["respaced"] and not got["torn"]["misread"]
    assert got["hyphen"]["text"] == "the reservoir matched the nerve"
    assert got["misread"]["text"] == "the margin of the temple was narrow and the and"
    assert got["page"]["text"] == f"{wrapped} and the fold matched the nerve ending" and got["page"]["furniture"] == 1
    assert "Vol" not in got["header"]["text"]
    assert "Narrow reservoir" in got["table"]["text"] and "45.2" in got["table"]["text"] and "temple" in got["table"]["text"]
    assert scans.repaired(df.filter("false")).count() == 0


def test_lines_that_recur_are_furniture(spark):
    r = random.Random(6)
    words = ["".join(r.choice("dfgkmpt") + r.choice("aeiou") for _ in range(3)) for _ in range(150)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [("p", f"h{i}", f"{line(9)}\nJOURNAL OF ODD THINGS {i}\n{line(9)}\n{line(5)}", False) for i in range(6)]
    same = f"{line(9)}\n{line(8)}\n{line(9)}"
    rows += [("p", f"same{i}", same, False) for i in range(8)] + [("p", f"c{i}", f"{line(9)}\n{line(9)}\n{line(9)}", False) for i in range(50)]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string, is_table boolean")
    got = {x["rec_id"]: x["text"] for x in scans.repaired(df).collect()}
    assert set(got) == {f"h{i}" for i in range(6)} and not any("ODD" in t for t in got.values())


def test_paragraphs_of_lines():
    d = scans.Decoder({"a": 1})
    many = [f"line number {i} of a long page of text" for i in range(900)]
    assert d.paragraphs(many) == [" ".join(many)]
    whole = scans.Decoder({"reservoir": 50, "the": 900, "minimum": 30})
    assert whole.fix("rniniinurn") is None and whole.fix("rninirnurn")[1] == "minimum" and whole.fix("re5erv01r")[1] == "reservoir"
    lines = ["The first line of a paragraph that is long", "and its end.", "Another begins here with a line that is", "long and goes on."]
    assert d.paragraphs(lines) == [" ".join(lines[:2]), " ".join(lines[2:])]
    assert d.paragraphs([]) == []


def test_single_codec_round_trip():
    s = encoding.Single("cp1252")
    for t in ("café – “naïve”", "Größe über 5 µm", "日本語のテキスト", "κ = 0.5"):
        bad = t.encode("utf-8").decode("latin-1")
        assert s.from_utf8(bad, encoding.Counter(t)) == t


def test_language():
    assert [encoding.language(t) for t in ("the cat was in the house", "der Hund und die Katze", "el perro con los gatos", "病変部の厚さは", "皮损的面积变为", "치료 전 병변", "")] [:6] == ["en", "de", "es", "ja", "zh", "ko"]


def test_blank_is_unicode(spark):
    from papercairn.tables import blank

    df = spark.createDataFrame([(None,), ("",), ("  　\u0085",), ("a",)], "t string")
    assert [r[0] for r in df.select(blank(F.col("t"))).collect()] == [True, True, True, False]
