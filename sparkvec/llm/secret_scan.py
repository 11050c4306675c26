"""Secret scanning with a random forest that removes false positives; DataFrame operations only.

Every run of twelve or more key characters with a letter and a digit is a candidate, wherever in a word it stands. A
forest, trained by MLlib on labelled findings, judges each by its length, its character transitions, how much of it a
dictionary covers, its path, what stands by it in its word and the words before. The trees are written out as expressions, so that a document's candidates are found,
described and judged within its own row: the scan has no shuffle, however many candidates a document or source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm.common import table, text_or_empty, unused

#: The labelled findings are made by these rules, `case`s of LABELLED_ROWS rows by row number. Each gives
#: the two words before, the word itself with {h} for hexadecimal and {m} for mixed random characters, and the label.
LABELLED_ROWS = 6000
CASES = [
    ('token', '=', '"{h40}"', 1), ('on', 'token', '="{h40}"', 1), ('the', 'and', 'password={h18}', 1), ('in', 'of', 'password={h16}', 1), ('for', 'password:', '{m20}', 1),
    ('the', 'key', 'AKIA{U16}', 1), ('est', 'und', 'AKIA{U16}', 1), ('login', 'with', 'ghp_{m36}', 1), ('aws', 'secret_key:', '{m40}', 1), ('use', 'api_key', '={h32}', 1),
    ('const', 'apiKey=', "'{m32}'", 1), ('Authorization:', 'Bearer', '{m48}', 1), ('de', 'la', 'sk_live_{m24}', 1), ('access', 'token:', '{m32}', 1), ('client_secret', '=', '"{m24}"', 1),
    ('see', 'commit', '{h40}', 0), ('git', 'commit', '{h40}', 0), ('sha256', 'checksum', '{h64}', 0), ('the', 'md5:', '{h32}', 0), ('in', 'file', 'src/module{d1}/part{d2}.py', 0),
    ('mail', 'to', '{w}.{d2}@mail{d1}.example.com', 0), ('at', 'https', 'www.{w}{d2}.example.org/index.html', 0), ('uuid', 'id', '{h8}-{h4}-{h4}-{h4}-{h12}', 0), ('the', 'of', '{w}{w}{d4}', 0),
    ('install', 'package', '{w}-{d1}.{d2}.{d1}-linux_x86_64.whl', 0), ('class', 'the', 'col-md-{d2}-{w}-large', 0), ('date', 'on', '20{d2}-0{d1}-1{d1}T0{d1}:00:00Z', 0), ('page', 'http', '/home/{w}/docs{d1}/{w}.txt', 0),
    ('digest', '=', '"{h40}"', 0), ('of', 'the', '{w}_{w}_{d2}', 0), ('and', 'version', 'release{d4}candidate{d1}', 0), ('blob', 'hash', '{h40}', 0),
]
#: Words that stand by secrets, words that stand by other long strings, and words that names are made of.
SECRET_WORDS = "token|secret|passw|passwd|pwd|api_?key|apikey|access_?key|auth|bearer|credential|private"
OTHER_WORDS = "commit|sha|md5|checksum|digest|hash|uuid|blob|file|version|package|mail|http|page|class|date|install"
DICTIONARY = "the|and|ing|tion|index|example|mail|home|user|docs?|src|module|part|file|page|class|com|org|net|www|html?|txt|json|test|main|data|release|candidate|version|linux|large|small|col|row|name|type|list|with|from|that|this|have|not|for|you|are|was|all|new|one|out|open|read|write|time|year"
FAMILIAR = "AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[bp]-|AIza|eyJ"
FEATURES = ["length", "runs", "digits", "uppers", "vowels", "consonants", "distinct", "hex", "covered", "path", "dots", "dashes", "known", "beside", "other", "assigned"]

_KEY = "[A-Za-z0-9+/_~.-]"
#: A word's pieces: runs of key characters, with the signs that pad one but assign nothing, and what lies between runs.
_PIECE = rf"{_KEY}+(?:={{1,2}}+(?!{_KEY}*[A-Za-z0-9]))?|[^A-Za-z0-9+/_~.-]+"
#: A candidate sees so many pieces of its word before it, and so many characters of these, of the next piece and of each
#: of the two words before; so a long text without white space costs in proportion to its length.
_PIECES, _SEEN = 3, 64
_FIELDS = ("value", "lead", "after", "before", "first")
_FORESTS: dict = {}


def _likely(c: Column) -> Column:
    return c.rlike(_KEY + "{12}") & c.rlike("[0-9]") & c.rlike("[A-Za-z]")


def candidates(word: Column, before: Column, first: Column) -> Column:
    """An array, in order, of structs (value, lead, after, before, first) of the candidates in a word: what stands by each."""
    seen = [F.right(c, F.lit(_SEEN)) for c in (before, first)]

    def one(pieces: Column, at: Column) -> Column:
        lead = F.array_join(F.slice(pieces, F.greatest(at - _PIECES, F.lit(0)) + 1, F.least(at, F.lit(_PIECES))), "")
        after = F.coalesce(F.left(F.get(pieces, at + 1), F.lit(_SEEN)), F.lit(""))
        return F.struct(F.get(pieces, at).alias("value"), F.right(lead, F.lit(_SEEN)).alias("lead"), after.alias("after"), seen[0].alias("before"), seen[1].alias("first"))

    def of(pieces: Column) -> Column:
        places = F.filter(F.transform(pieces, lambda p, k: F.when(_likely(p), k).otherwise(-1)), lambda k: k >= 0)
        return F.transform(places, lambda k: one(pieces, k))

    # An array of one, so that the pieces are made once and not for each candidate.
    return F.flatten(F.transform(F.array(F.regexp_extract_all(word, F.lit(_PIECE), F.lit(0))), of))


def described(value: Column, lead: Column, after: Column, before: Column, first: Column) -> dict[str, Column]:
    """The features of a candidate value, what leads to it and follows it in its word, the word before it and the one
    before that. All doubles."""
    n = F.length(value).cast("double")
    share = lambda pattern: 1 - F.length(F.regexp_replace(value, pattern, "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9"), "[^aA9]", "-")
    near = F.lower(F.concat_ws(" ", first, before, lead))
    number = lambda c: c.cast("double")
    login = lead.rlike("//[^/@]*:$") & after.startswith("@")  # the password's place in a URL
    return {
        "length": n,
        "runs": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "vowels": share("[aeiouAEIOU]"),
        "consonants": share("[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]{4,}"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex": number(value.rlike("^[0-9a-f]+$")),
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), DICTIONARY, "")) / n,
        "path": number(F.length(value) - F.length(F.replace(value, F.lit("/"), F.lit("")))) + number(value.rlike(r"\.[a-z]{2,4}$")),
        "dots": number(F.length(value) - F.length(F.replace(value, F.lit("."), F.lit("")))),
        "dashes": number(F.length(value) - F.length(F.regexp_replace(value, "[-_]", ""))),
        "known": number(value.rlike(f"^({FAMILIAR})")),
        "beside": number(login | near.rlike(SECRET_WORDS)),
        "other": number(near.rlike(OTHER_WORDS)) + number(~login & F.concat(lead, value, after).rlike("@|://")),
        "assigned": number(F.concat_ws(" ", before, lead, value).rlike("[=:]")),
    }


def labelled_findings(spark: SparkSession) -> DataFrame:
    """The fields of candidates() and label: LABELLED_ROWS findings of CASES in turn, with random parts by row number."""

    def filled(template: str) -> Column:
        parts, seed = [], 0
        while template:
            head, _, rest = template.partition("{")
            if head:
                parts.append(F.lit(head))
            if not rest:
                break
            code, _, template = rest.partition("}")
            seed += 1
            key = F.concat_ws("/", F.col("id").cast("string"), F.lit(f"{seed}/{code}"))
            n = int(code[1:] or 8)
            if code[0] == "h":
                parts.append(F.substring(F.concat(F.sha2(key, 256), F.sha2(key, 512)), 1, n))
            elif code[0] == "d":
                parts.append(F.lpad(F.pmod(F.xxhash64(key), F.lit(10**n)).cast("string"), n, "1"))
            elif code[0] == "w":
                parts.append(F.element_at(F.array(*map(F.lit, ["report", "banner", "column", "letter", "harbor", "summer", "silver", "market"])), (F.pmod(F.xxhash64(key), F.lit(8)) + 1).cast("int")))
            else:
                mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(key, 512))), "[+/=]", "")
                parts.append(F.substring(mixed if code[0] == "m" else F.upper(mixed), 1, n))
        return F.concat(*parts)

    kind = F.pmod(F.col("id"), F.lit(len(CASES)))
    word, before, first, label = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0)
    for k, (a, b, c, y) in enumerate(CASES):
        word, before = F.when(kind == k, filled(c)).otherwise(word), F.when(kind == k, F.lit(b)).otherwise(before)
        first, label = F.when(kind == k, F.lit(a)).otherwise(first), F.when(kind == k, F.lit(y)).otherwise(label)
    rows = spark.range(0, LABELLED_ROWS, 1, 2).select("id", word.alias("word"), before.alias("before"), first.alias("first"), label.cast("double").alias("label"))
    return rows.select("label", F.inline(candidates(*map(F.col, ("word", "before", "first")))))


def forest(spark: SparkSession, trees: int = 20, depth: int = 6, seed: int = 1) -> list:
    """Trees as nested (feature, threshold, left, right) with the share of secrets at the leaves; trained once a session."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    key = (spark.sparkContext.applicationId, trees, depth, seed)
    if key not in _FORESTS:
        found = labelled_findings(spark)
        rows = found.select("label", *(c.alias(k) for k, c in described(*map(F.col, _FIELDS)).items()))
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))

        def taken(node):
            if node.subtreeDepth() == 0:
                stats = list(node.impurityStats().stats())
                return stats[1] / sum(stats)
            return FEATURES[node.split().featureIndex()], node.split().threshold(), taken(node.leftChild()), taken(node.rightChild())

        _FORESTS[key] = [taken(t._java_obj.rootNode()) for t in model.trees]
    return _FORESTS[key]


def _judged(tree, c: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, threshold, left, right = tree
    return F.when(c[name] <= threshold, _judged(left, c)).otherwise(_judged(right, c))


def with_findings(docs: DataFrame, threshold: float = 0.5, out: str = "_found") -> DataFrame:
    """docs with out: an array, in text order, of structs (value, score, secret) of the candidates in text.

    Null and empty texts give empty arrays; rows are independent, so ties and repeated rows need no rule, and a text of any
    length is read whole, in its own row. Other columns are kept, whatever their names; one named as out is replaced. No
    rows give none.
    """
    trees = forest(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    row, words, index, raw, told, scored = unused(["text", out], "_row", "_words", "_at", "_raw", "_told", "_scored")
    at = lambda words, i: F.when(i >= 0, F.get(words, i)).otherwise(F.lit(""))
    total = lambda c: sum((_judged(t, c) for t in trees[1:]), _judged(trees[0], c)) / len(trees)
    split = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias(row), F.split(text_or_empty(), r"\s+").alias(words))
    found = split.withColumn(index, F.filter(F.transform(words, lambda w, i: F.when(_likely(w), i).otherwise(-1)), lambda i: i >= 0))
    one = lambda i: candidates(F.get(F.col(words), i), at(F.col(words), i - 1), at(F.col(words), i - 2))
    raws = found.select(row, F.flatten(F.transform(index, one)).alias(raw))
    tells = raws.select(row, F.transform(raw, lambda c: F.struct(c["value"].alias("value"), *(x.alias(k) for k, x in described(*(c[k] for k in _FIELDS)).items()))).alias(told))
    scores = tells.select(row, F.transform(told, lambda c: F.struct(c["value"].alias("value"), total(c).alias("score"))).alias(scored))
    verdict = F.transform(scored, lambda c: F.struct(c["value"].alias("value"), c["score"].alias("score"), (c["score"] >= threshold).alias("secret")))
    return scores.select(f"{row}.*", verdict.alias(out))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mark; n_chars, where docs has it, follows. Null texts stay null, empty ones
    empty; rows are independent; all columns are kept, whatever their names; no rows give none."""
    found, secrets = unused(docs.columns, "_found", "_secrets")
    # Longest first: one that is part of another must not leave the rest of that one in the text.
    values = F.array_distinct(F.transform(F.filter(found, lambda c: c["secret"]), lambda c: c["value"]))
    longest = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    marked = with_findings(docs, out=found).withColumn(secrets, longest)
    changed = F.aggregate(secrets, F.col("text"), lambda t, s: F.replace(t, s, F.lit(mark)))
    out = marked.withColumn("text", F.when(F.size(secrets) > 0, changed).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.size(secrets) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_candidates, n_secrets, secrets (in text order, repeated ones too), top_score (0 without candidates)."""
    found = with_findings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("_found").cast("long").alias("n_candidates"), F.expr("size(filter(_found, c -> c.secret))").cast("long").alias("n_secrets"),
        F.expr("transform(filter(_found, c -> c.secret), c -> c.value)").alias("secrets"), F.expr("coalesce(array_max(transform(_found, c -> c.score)), 0.0D)").alias("top_score"),
    )
