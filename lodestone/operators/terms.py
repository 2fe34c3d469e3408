"""Terms that two languages share, found in names, aliases and file names.

Where two sources name one term, the later one counts: names before file names, both in the order of the rows, all before the
dictionary given. A term of several words is also known without its blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.concepts import HANGUL

# The dictionary that every term map starts from.
DEFAULT_TERMS = [
    ("앱", "app"), ("어플", "app"), ("어플리케이션", "application"), ("애플리케이션", "application"), ("블루", "blue"), ("불루", "blue"), ("맥스", "max"), ("멕스", "max"),
    ("패스워드", "password"), ("비밀번호", "password"), ("아이피", "ip"), ("주소", "address"), ("명령어", "command"), ("설치", "install"), ("가이드", "guide"), ("유저", "user"),
    ("사용자", "user"), ("보고서", "report"), ("체크", "check"), ("확인", "check"), ("로그", "log"), ("기록", "log"), ("배치", "batch"), ("일괄", "batch"), ("블랙리스트", "blacklist"),
    ("차단목록", "blacklist"), ("머신러닝", "machine learning"), ("머신 러닝", "machine learning"), ("인공지능", "artificial intelligence"), ("딥러닝", "deep learning"), ("딥 러닝", "deep learning"),
    ("자연어처리", "natural language processing"), ("자연어 처리", "natural language processing"),
]
ENGLISH = r"^[a-zA-Z\s]+$"


def _pair(a: Column, b: Column) -> Column:
    """struct(term, other) if one of the two is Korean and the other English, else null."""
    ko = lambda x: x.rlike(HANGUL)
    en = lambda x: x.rlike(ENGLISH)
    pair = lambda k, e: F.struct(F.lower(k).alias("term"), F.lower(e).alias("other"))
    return F.when(ko(a) & en(b), pair(a, b)).when(en(a) & ko(b), pair(b, a))


def named_terms(files: DataFrame) -> DataFrame:
    """(term, other, ord): what each file says. files: (ord, stem, name, aliases); later rows have greater `ord`.

    Of a name's aliases the first in the other language counts; of a stem's parts every neighbouring pair does.
    """
    by_name = F.get(F.filter(F.transform("aliases", lambda a: _pair(F.col("name"), a)), lambda p: p.isNotNull()), F.lit(0))
    parts = F.split("stem", "-")
    by_stem = F.transform(F.zip_with(parts, F.slice(parts, 2, F.size(parts)), lambda a, b: F.when(b.isNotNull(), _pair(a, b))), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    names = files.select(F.struct(F.lit(1).alias("kind"), F.col("ord").alias("ord"), F.lit(0).alias("i")).alias("ord"), by_name.alias("p"))
    stems = files.select("ord", F.explode(by_stem).alias("x")).select(F.struct(F.lit(2).alias("kind"), F.col("ord").alias("ord"), F.col("x.i").alias("i")).alias("ord"), F.col("x.p").alias("p"))
    return names.unionByName(stems).where(F.col("p").isNotNull()).select("p.term", "p.other", "ord")


def term_map(files: DataFrame, default: list[tuple[str, str]] | None = None) -> DataFrame:
    """(term, other) over all files and the dictionary, with the forms without blanks. Terms are combined before the shuffle."""
    spark = files.sparkSession
    kind = "struct<kind:int,ord:bigint,i:int>"
    given = spark.createDataFrame([(k, e, (0, i, 0)) for i, (k, e) in enumerate(DEFAULT_TERMS if default is None else default)], f"term string, other string, ord {kind}")
    said = named_terms(files).withColumn("ord", F.col("ord").cast(kind)).unionByName(given)
    base = said.groupBy("term").agg(F.max_by("other", "ord").alias("other"), F.min("ord").alias("first"))
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    forms = F.array(
        F.when(F.contains("term", F.lit(" ")), F.struct(bare("term").alias("term"), F.col("other").alias("other"), F.lit(0).alias("k"))),
        F.when(F.contains("other", F.lit(" ")), F.struct(F.col("term"), bare("other").alias("other"), F.lit(1).alias("k"))),
    )
    extra = base.select("first", F.inline(F.array_compact(forms))).select("term", "other", F.struct(F.lit(1).alias("level"), "first", "k").alias("ord"))
    every = base.select("term", "other", F.struct(F.lit(0).alias("level"), "first", F.lit(0).alias("k")).alias("ord")).unionByName(extra)
    return every.groupBy("term").agg(F.max_by("other", "ord").alias("other"))


def in_both_directions(pairs: DataFrame) -> DataFrame:
    """(term, others): every term of either language with all that it is known as, sorted."""
    both = pairs.select("term", "other").unionByName(pairs.select(F.col("other").alias("term"), F.col("term").alias("other")))
    return both.groupBy("term").agg(F.array_sort(F.collect_set("other")).alias("others"))

