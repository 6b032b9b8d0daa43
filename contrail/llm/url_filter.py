"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for all other URLs.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to ``?``, ``#``
or the end; both empty for null and for URLs without ``://``. A rule (host and path in one string) fits its host and all
subdomains if the path starts with the rule's path; the longest rule that fits decides. Rules are a short list written
into the expression.

The model is trained from a small labelled URL table (448 invented URLs, see ``labelled_table``) on hashed n-grams of ``host`` and of ``path`` (1 to 3 bytes of
UTF-8, host and path kept apart), with Spark's own logistic regression; features, training and scoring stay in the JVM.

Defined cases: null and malformed URLs have empty host and path, no rule fits, the model judges the empty strings;
repeated rows are judged alike; very long URLs are used whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.common import let

#: (verdict, host and path) of each rule.
Rule = tuple[str, str]

#: Stems of the labelled URLs' words, invented hosts under reserved names: 1 is to be blocked, 0 is not.
STEMS = {
    1: "casino jackpot poker slots betting viagra pills pharmacy xxx adultcams escort warez keygen torrent payday freebitcoin cryptodouble lottery replica dietmiracle singles getrich clickbait adbanner tracker phishing verifyaccount backlinks",
    0: "news library museum university science weather recipes garden travel health council football music albums tutorial forum journal books children maps history physics gallery theatre railway archive newsletter orchard",
}
#: What a stem is put together with, and the forms of a URL: the same ones for both classes, so that neither says anything.
AFFIXES = ("{s}", "{s}online", "my-{s}", "best{s}", "{s}-world", "top-{s}", "{s}hub", "the{s}", "{s}24", "city-{s}")
FORMS = ("http://{w}.example/", "http://www.{w}-{n}.example/about", "https://{w}.example/en/article-{n}.html", "http://site{n}.example/{w}/2024", "http://{w}{n}.example/index.html", "https://go.example/{w}/click.php", "http://pages.example/offers/{w}-{n}", "https://{w}-now.example/claim?id={n}", "http://shop.example/de/{w}/{n}", "http://www.{w}.example/play", "http://open.example/docs/{w}-{n}", "https://a.{w}.example/free/{n}")


def host(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    found = F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(c, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: list[Rule], host_col: Column, path_col: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does. Equally long rules: the first by code point."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        at, _, rest = r.partition("/")
        fits = ((host_col == at) | host_col.endswith("." + at)) & path_col.startswith("/" + rest if "/" in r else "")
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _ngrams(text: Column, mark: str, low: int, high: int) -> Column:
    """n-grams of a text's UTF-8 bytes (their substrings take constant time), with a mark in front; none if it is shorter than n."""

    def grams(data: Column, n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(data) - (n - 1)), lambda i: F.concat(F.lit(mark), F.substr(data, i, F.lit(n)).cast("string")))
        return F.when(F.length(data) >= n, each).otherwise(F.array().cast("array<string>"))

    def of(data: Column) -> Column:
        return F.concat(*[grams(data, n) for n in range(low, high + 1)])

    return let(F.encode(text, "utf-8"), of)


def features(urls: DataFrame, url_col: str = "url", low: int = 1, high: int = 3) -> DataFrame:
    """Adds ``host, path, grams``."""
    x = urls.withColumn("host", host(url_col)).withColumn("path", path(url_col))
    return x.withColumn("grams", F.concat(_ngrams(F.col("host"), "h", low, high), _ngrams(F.col("path"), "p", low, high)))


def labelled_table(spark: SparkSession) -> DataFrame:
    """``label, url, kind, held_out``: the words of each stem, each in a third of the forms, turn by turn.

    ``kind`` is ``train`` or what training has not seen: ``stem`` (every seventh stem, with all its words), ``word`` (a fifth of
    the words of other stems), ``form`` (every fourth form) or ``both`` of these two; all but ``train`` are held out.
    """
    rows = []
    for y, said in STEMS.items():
        for i, stem in enumerate(said.split()):
            for a, affix in enumerate(AFFIXES):
                for j in range((i + a) % 3, len(FORMS), 3):
                    word, form = (i + a) % 5 == 4, j % 4 == 3
                    kind = "stem" if i % 7 == 6 else "both" if word and form else "word" if word else "form" if form else "train"
                    rows.append((float(y), FORMS[j].format(w=affix.format(s=stem), n=17 * i + 5 * a + j), kind, kind != "train"))
    return spark.createDataFrame(rows, "label double, url string, kind string, held_out boolean")


def fit(labelled: DataFrame, url_col: str = "url", buckets: int = 1 << 12) -> PipelineModel:
    """Train on ``url_col, label`` (1: block)."""
    tf = HashingTF(inputCol="grams", outputCol="tf", numFeatures=buckets, binary=True)
    lr = LogisticRegression(featuresCol="tf", labelCol="label", regParam=0.02, maxIter=50)
    return Pipeline(stages=[tf, lr]).fit(features(labelled, url_col).coalesce(1))


def judge(urls: DataFrame, model: PipelineModel, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict, p_block`` for each row."""
    x = model.transform(features(urls.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("url"))))
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    p = vector_to_array("probability")[1]
    return x.select(F.col("__id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("p_block"))
