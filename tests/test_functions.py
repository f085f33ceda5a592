"""Rules on small inputs with literal expectations."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import scalars as S
from gleaner.functions import unicode as U
from gleaner.operators import classify


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in inputs.items()))
    return row.select(column.alias("x")).first().x


X = F.col("x")


@pytest.mark.parametrize(
    ("text", "lang"),
    [("君の名は。夢を見る", "ja"), ("안녕하세요 세상", "ko"), ("我们是中国人", "zh"), ("Привет мир", "ru"), ("I love you and you love me", "en"), ("Bailando por la noche entera", "und"), ("♪ ♪ 123", "en"), ("", "en")],
)
def test_languages(spark, text, lang):
    assert value(spark, S.guess_language(U.nfc(X), U.nfkc_fold(X)), x=text) == lang


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("Song", "song", 1.0), ("a b", "b a", 0.99), ("one two", "one three", 1 / 3), ("", "x", 0.0), ("Ｆｕｌｌ", "full", 1.0)],
)
def test_match_score(spark, a, b, score):
    assert value(spark, S.match_score(S.words(U.nfkc_fold(F.col("a"))), S.words(U.nfkc_fold(F.col("b")))), a=a, b=b) == pytest.approx(score)


@pytest.mark.parametrize(
    ("title", "tidy", "markers"),
    [
        ("Song (Official Video)", "Song", []), ("Song (Live at X) [Remix]", "Song", ["live", "remix"]), ("Song - Sped Up", "Song -", ["spedup"]), ("Song (slowed + reverb)", "Song ( )", ["reverb", "slowed"]),
        ("Live and Let Die", "Live and Let Die", []), ("Song - Instrumental", "Song", ["instrumental"]), ("Song lyrics", "Song", []),
    ],
)
def test_titles(spark, title, tidy, markers):
    assert value(spark, S.tidy_title(U.clean_text(X)), x=title) == tidy
    assert value(spark, S.variant_markers(U.clean_text(X)), x=title) == markers


@pytest.mark.parametrize(
    ("stem", "pattern", "track", "artist", "title"),
    [
        ("01 - Artist - Title", "artist_dash_title", "01", "Artist", "Title"), ("Artist – Title", "artist_dash_title", None, "Artist", "Title"), ("solo (X remix)", "title_with_annotation", None, None, "solo (X remix)"),
        ("Fred & T (Palace, London)", "artist_paren_details", None, "Fred & T", "Palace, London"), ("03 Kyle", "raw", "03", None, "Kyle"), ("50 Cent - X", "artist_dash_title", "50", "Cent", "X"), ("Plain", "raw", None, None, "Plain"),
    ],
)
def test_parse_filename(spark, stem, pattern, track, artist, title):
    r = value(spark, S.parse_filename(X), x=stem)
    assert (r.pattern, r.track, r.artist, r.title) == (pattern, track, artist, title)


def test_artists(spark):
    assert value(spark, S.split_artists(X), x="A feat. B; Unknown Artist;C & D") == ["A", "B", "C & D"]
    assert value(spark, S.name_parts(X), x="A & B x C") == ["A", "B", "C"] and value(spark, S.name_parts(X), x="Solo") == []
    assert value(spark, S.artist_variants(X), x="Hero(CV:Actor)") == ["Hero(CV:Actor)", "Hero", "Actor"]
    assert value(spark, S.first_artist(X), x="A ft. B, C") == "A"


def test_romaji():
    for romaji, kana in [
        ("Yume naraba dore hodo yokatta deshou", "ゆめならばどれほどよかったでしょう"),
        ("Imada ni anata no koto wo yume ni miru", "いまだにあなたのことをゆめにみる"),
        ("watashi wa gakusei desu", "わたしはがくせいです"),
        ("Tōkyō e ikou", "とうきょうへいこう"),
        ("ŌSAKA kūki onēsan obāsan oniisan oishī", "おうさかくうきおねえさんおばあさんおにいさんおいしい"),
        ("Kekkon shite", "けっこんして"),
        ("kannai kin'iro ra-men", "かんないきんいろらーめん"),
        ("I love you so much", "I love you so much"),
        ("Lemon no nioi", "Lemonのにおい"),
        ("", ""),
    ]:
        assert U.py_romaji_to_kana(romaji) == kana
    # words of generated syllables, none of which runs into the next
    rng = random.Random(4)
    syllables = [k for k in U.KANA if k != "n" and k[0] not in "aiueoy"]
    for _ in range(300):
        parts = rng.choices(syllables, k=rng.randint(1, 6))
        if all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False)):
            assert U.py_kana_word("".join(parts)) == "".join(U.KANA[p] for p in parts)


def test_formats(spark):
    assert value(spark, S.minutes_rounded(X), x=62.5) == "1:02" and value(spark, S.minutes_cut(X), x=62.9) == "1:02" and value(spark, S.minutes_cut(X.cast("double")), x=None) == "--:--"
    assert value(spark, S.human_size(X), x=1536) == "1.5 KB" and value(spark, S.human_size(X), x=10) == "10 B"
    assert value(spark, S.compact(X), x=1234567) == "1.2M" and value(spark, S.compact(X), x=8500) == "8.5K" and value(spark, S.compact(X), x=3_000_000) == "3M"
    assert value(spark, S.timestamp(X), x=61.239) == "01:01.24"


def test_unicode_rules(spark):
    assert U.py_norm("Ｆｒｅｄ again..！") == "fredagain"
    assert U._album_key("Ado - Show - EP", "Ado") == U._album_key("SHOW", "Ado") == "show"
    assert U._album_identity("Show (Deluxe)", "Ado") == "show"
    assert U.py_romaji_to_kana("kimi wa matcha") == "きみはまっちゃ" and U.py_romaji_to_kana("Baby tell them never") == "Baby tell them never"
    assert U._romanize_cyrillic("Щёлкунчик") == "Shchyolkunchik" and U._romanize_hangul("안녕하세요") == "annyeonghaseyo"
    assert U.py_decode("こんにちは、世界".encode("cp932")) == "こんにちは、世界" and U.py_decode("안녕하세요".encode("euc-kr")) == "안녕하세요"
    assert U.py_sanitize('a/b: "c"?') == "a-b - c" and len(U.py_sanitize("夢" * 100).encode()) <= 200 and U.py_sanitize("") == "Unknown"


def evaluated(spark, **k):
    d = {"found": True, "skew": 0.0, "local": 185.0, "cat": 185.0, "generic": False, "lr": False, "cr": False, "overlap": True, "issue": None} | k
    row = spark.createDataFrame([tuple(d.values())], "found boolean, skew double, local double, cat double, generic boolean, lr boolean, cr boolean, overlap boolean, issue string")
    c = F.col
    r = row.select(classify.evaluate_match(c("found"), c("skew"), F.lit(None).cast("double"), c("local"), c("cat"), c("generic"), c("lr"), c("cr"), c("overlap"), c("issue")).alias("x")).first().x
    return r.status, r.confidence


def test_evaluation(spark):
    assert evaluated(spark, generic=True) == ("IDENTIFIED", 1.0)
    assert evaluated(spark, local=3600.0) == ("REJECT_MIX", 0.0)
    assert evaluated(spark, local=15.0, cat=240.0) == ("REJECT_SNIPPET", 0.2)
    assert evaluated(spark, lr=True) == ("POTENTIAL_REMIX", 0.7)
    assert evaluated(spark, overlap=False) == ("MISLABELED", 1.0)
    assert evaluated(spark, skew=0.08) == ("REJECT_SKEW", 0.2)
    assert evaluated(spark, found=None) == ("NO_MATCH", 0.0)
    assert evaluated(spark, cat=None) == ("CONFIRMED", 0.85)
    assert evaluated(spark, cat=None, issue="x") == ("CONFIRMED", 1.0)


@pytest.mark.parametrize(
    ("stem", "issue"),
    [("track 01", "Generic or placeholder filename"), ("abba", "Generic or placeholder filename"), ("01 Song", "Leading track number in filename"), ("A - B [HD]", "Video/media annotation in filename"),
     ("A - B (320 kbps)", "Junk annotation in filename"), ("A - B_c", "Underscores in filename"), ("Lonely", "Missing artist separator in filename"), ("A - Song", None)],
)
def test_name_issue(spark, stem, issue):
    assert value(spark, classify.name_issue(X), x=stem) == issue


def test_severe_mismatch(spark):
    def severe(stem, title):
        row = spark.createDataFrame([(stem, title)], "a string, b string").select(U.strip_marks("a").alias("a"), U.strip_marks("b").alias("b"))
        return classify.severe_mismatch(row, "a", "b").first().severe

    assert severe("Boiler Room London DJ Set", "Delilah (pull me out of this)") is True
    # one pair of words alike is enough
    assert severe("Some Long Unrelated Beginning Novacane", "Qqq Zzzzzzzz Wwwwww Novocane") is False
    assert severe("Some Long Unrelated Beginning Alpha", "Qqq Zzzzzzzz Wwwwww Jumped") is True
    assert severe("Novacane", "Novocaine") is False and severe("夢", "Yume") is False and severe("x", "") is False


def test_sizes_round_as_c_does(spark):
    sizes = [6553600.0, 7077888.0, 1024 * 1.15, 1024 * 1.55, 1024 * 1.85, 1024 * 1.95, 1048575.9, 1073741824 * 40.25, 1073741824 * 40.75]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "x double").select(S.human_size(X)).collect()]
    units = [(2**20, "MB"), (2**20, "MB"), *[(1024, "KB")] * 5, (2**30, "GB"), (2**30, "GB")]
    assert got == ["%.1f %s" % (x / k, unit) for x, (k, unit) in zip(sizes, units, strict=True)]


def test_scripts_are_counted_from_two_passes_over_a_text(spark):
    texts = ["Plain words, 12!", "été naïve ŵ", "ひらカナ漢字abc", "Привет мир", "한글 text", "עברית ﬁ 𝒜x", "", None, "Ελλ abc é"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    rest = "".join(S.SCRIPTS.values())
    naive = {n: F.char_length(F.regexp_replace("x", f"[^{p}]", "")) for n, p in S.SCRIPTS.items()}
    naive["latin"] = F.char_length(F.regexp_replace("x", rf"[^[\p{{L}}&&[\x{{0000}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}]&&[^{rest}]]]", ""))
    naive["other"] = F.char_length(F.regexp_replace(F.regexp_replace("x", r"[^\p{L}]", ""), rf"[{rest}\x{{0000}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}]", ""))
    assert df.select(*(v.alias(k) for k, v in S.script_counts(X).items())).collect() == df.select(*(v.alias(k) for k, v in naive.items())).collect()
    plan = df.select(S.guess_language(X))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(x#") == 2
