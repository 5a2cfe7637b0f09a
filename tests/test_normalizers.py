"""Normalisers of fields: literal cases."""

from pyspark.sql import functions as F

from lectern.functions import normalizers as nf
from lectern.functions import text as fx
from lectern.operators import files


def of(spark, f, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def check(spark, f, cases, kind="string"):
    assert of(spark, f, list(cases), kind) == list(cases.values())


def test_names(spark):
    check(spark, nf.unshouted, {"SANDRA BROWN": "Sandra Brown", "bell hooks": "bell hooks", "MacDonald": "MacDonald", "BBC": "Bbc", "1984": "1984", "": "", None: None, "JOHN A SMITH": "John A Smith"})
    check(spark, nf.author_name, {
        "SANDRA BROWN": "Sandra Brown", "BBC": "B. B. C.", "R.R. Tolkien": "R. R. Tolkien", "JRR Tolkien": "J. R. R. Tolkien", "SueEllen Page": "Sue Ellen Page", "MacDonald": "MacDonald", "J. D. Robb=": "J. D. Robb", "John_Smith": "John Smith", "Ken Follett III": "Ken Follett III",
        "bell hooks": "bell hooks", "": "", None: None, "A McIntyre": "A. McIntyre", "SueMacDonald": "Sue MacDonald", "ElodeBran": "Elode Bran",
    })
    check(spark, nf.person_name, {"AC Crispin": True, "A. Lee Martinez": True, "Kim Stanley Robinson": True, "AJ Hartley and David Hewson": True, "[Ciaphas Cain 13]": False, "1984": False, "the collected works": False, "van de": False, "Ursula K. Le Guin": True, None: False, "": False, "A B C D E": False})
    check(spark, lambda c: fx.title_case(c, small_words=False), {"john a smith": "John A Smith", "ludwig van beethoven": "Ludwig Van Beethoven"})


def test_lists(spark):
    assert of(spark, nf.genres, [["sci-fi", "Sci Fi", " ", None, "FANTASY"], []], "array<string>") == [["Sci Fi", "Fantasy"], []]
    assert of(spark, lambda c: nf.genres(c, {" SciFi ": "science fiction"}, ("Science Fiction", " ")), [["scifi", "horror", "Science fiction"]], "array<string>") == [["Science Fiction"]]
    check(spark, nf.split_list, {"a; b;;c ": ["a", "b", "c"], "": [], None: []})
    assert of(spark, nf.join_list, [["a", "b"], []], "array<string>") == ["a; b", None]
    assert of(spark, lambda c: nf.distinct_by(c, F.lower), [["a", "B", "A", "b", "c"]], "array<string>") == [["a", "B", "c"]]
    assert of(spark, lambda c: nf.merged(c, F.array(F.lit("b "), F.lit("x"), F.lit(""))), [["a", "b"], None], "array<string>") == [["a", "b", "x"], ["b", "x"]]
    check(spark, nf.FIELDS["genre"], {"rock; ROCK;jazz": "Rock; Jazz", "": ""})


def test_numbers_and_extensions(spark):
    check(spark, nf.whole_number, {"12": 12, " 7 ": 7, "x": None, "1.5": None, None: None})
    check(spark, nf.year, {"2021-05": 2021, "99": 99, "abcd": None, None: None})
    check(spark, nf.container_family, {".MP3": "mpeg", "opus": "ogg", "x": None, None: None})


def test_quality_and_chapters(spark):
    rows = [(1, 128_000, "MP3"), (1, 124_500, "MP3"), (2, 128_000, "MP3"), (2, 320_000, "MP3"), (3, 128_000, "MP3"), (3, 128_000, "FLAC"), (4, 64_000, "MP3"), (4, 0, "FLAC"), (4, None, "AAC")]
    table = spark.createDataFrame([(*r, 44_100, 2) for r in rows], "p int, bitrate int, codec string, sample_rate int, channels int")
    assert {r["p"]: r["detail"] for r in files.mixed_quality(table, "p").collect()} == {2: "files span 128-320 kbps", 3: "files mix formats (FLAC + MP3)"}
    marks = spark.createDataFrame([(1, s, 100, k) for k, s in enumerate((50, -5, 30, 200))], "p int, s long, total long, k int")
    assert [tuple(r) for r in files.chapters(marks, "p", "s", "total", "k").orderBy("place").select("k", "begin", "end").collect()] == [(1, 0, 30), (2, 30, 50), (0, 50, 100), (3, 100, 100)]
    assert [tuple(r) for r in files.chapters(marks, "p", "s", "total", "k", -40).orderBy("place").select("k", "begin", "end").collect()] == [(1, 0, 0), (2, 0, 10), (0, 10, 100), (3, 100, 100)]
