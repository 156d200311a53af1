"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is a run of at least 12 of ``[A-Za-z0-9_+/-]`` that holds a digit or begins like a known kind of key, with up to two ``=`` behind it, or the value
after a sign of assignment or a key word such as ``password``: its printable characters up to a space, its closing quote or, unquoted, closing punctuation, however many they are.
Signs of assignment inside a value begin further ones that end with it, however many they are. A run and a value may overlap; alike ones are one candidate. The text is cut before each candidate in one pass for runs and one for values, so a candidate's position is the sum of the lengths before it (summed in blocks, so
a text of many candidates costs no square of them), and its neighbouring words are the end of the piece before and the start of the rest of its own. Unquoted values end where their word does, so up to the
rows candidates are positions only, and a row's text is cut out when the row is made: a word of many signs costs time by the sum of its values' lengths, but no memory for it. Features: length and distinct characters; shares of character kinds and of the transitions between them; dictionary
coverage (letters inside words of a fixed list); path; neighbouring words, and whether a call or an access follows. The forest (Spark's own, 24 trees) is trained on labelled findings: a table
candidate, before, after, path, label, or the 4,000 generated ones of ``labelled_findings``, which is also their bound. They hold
no text of the corpus.

Nothing is shuffled: a document is scanned where it is read, and what the training holds doesn't grow with the documents.

Defined cases: a null text counts as empty and has no findings; a null path is an unknown one; repeated rows are scanned alike; other columns
aren't needed and don't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Taken, text_of

CHARS = r"[A-Za-z0-9_+/-]"
#: Beginnings of known kinds of keys, which need no digit.
KNOWN = r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|pk|rk)_(?:live|test)_|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|AIza|eyJ)"
START = rf"(?<!{CHARS})(?={CHARS}{{12}})(?=[A-Za-z_+/-]*[0-9]|{KNOWN})"
CANDIDATE = rf"^{CHARS}{{12,}}={{0,2}}"
KEYWORD = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer)"
#: What stands before a value: a sign of assignment or a key word, and an opening quote; then the value's first character, which isn't taken in.
VALUE = rf"(?:[:=]>?[ \t]{{0,8}}+[\"'`]?+|\b{KEYWORD}[\"'`]?[ \t]{{1,8}}+(?:is[ \t]{{1,8}}+)?[\"'`]?+)(?=[^\s\"'`:=>])(?!//)"
#: The mark that is put where a value begins; in a text it and a second sign count as spaces.
MARK, SPACES = "\x01", "\x01\x02"
#: What every text with a value holds; texts without any of it are not searched for values.
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer")
#: A quoted value as it stands after its mark: up to white space or the quote that it opened with; nothing after other marks.
QUOTED = "|".join(rf"(?<={q}{MARK})[^\s{q}]*+" for q in "\"'`") + "|"
#: Where a word begins that holds a mark.
MARKED_WORD = rf"(?<=\s)(?=[^\s{MARK}]*+{MARK})"
#: Closing punctuation that doesn't belong to an unquoted value.
CLOSING = r"(?<![,;.)\]}>\"'`])[,;.)\]}>\"'`]++\z"
#: Signs without white space between beyond which values would end at the next sign: no number of them.
CROWDED = float("inf")
#: Numbers that are summed one by one, and candidates whose stretch of the text is cut out together.
STRIDE = 128
AROUND = 64
FINDINGS, TREES, DEPTH, SEED = 4_000, 24, 8, 7
#: Words of the dictionary that coverage counts.
WORDS = (
    "access account active address after author balance before branch build button bytes cache chapter class client code column commit config count create current data date default delete"
    " design detail digest document domain error event example file filter first folder format from function group guide handler hash header here home html http image index info input invoice"
    " item json label last length level library line link list local main manager message method model module name node number object option order output package page param part password path"
    " placeholder point policy process project public query read record release report request response result sample schema secret section serial server service session source stage start"
    " state status step string style table target template test text that theme this time title token tracking type update upload user uuid value version view width with write your"
).split()
NEAR = r"(?i)\b(pass(word|wd|phrase)?|pwd|secret|token|credentials?|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer)\b\W*(\w+\W+){0,2}$"
FAKE = r"(?i)\b(example|sample|dummy|placeholder|test|fake|your|changeme|redacted)"
PLAIN = r"(?i)\b(commit|sha-?\d*|md5|checksum|digest|uuid|guid|revision|serial|order|card|account|invoice|isbn|phone|tracking|version|id|page|see|file|path|url)\b\W*(\w+\W+){0,1}$"
PATHS = r"(?i)(^|[/_.-])(tests?|examples?|samples?|fixtures?|mocks?|docs?)([/_.-]|$)"

#: Features in the order of the vector.
FEATURES = ["length", "distinct", "upper", "lower", "digit", "other", "runs", "stay_letter", "stay_digit", "letter_digit", "digit_letter", "lower_upper", "hex", "covered", "assigned", "quoted", "near", "fake", "plain", "odd_path", "called"]


def count(text: Column, pattern: str) -> Column:
    """Matches of a pattern of one character or of lookarounds."""
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """found: candidate, before, after, path; with the columns of FEATURES."""
    c, before, after = F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    size = F.greatest(F.char_length(c), F.lit(1)).cast("double")
    pairs = F.greatest(size - 1, F.lit(1.0))
    low = F.lower(c)
    letters = F.greatest(count(c, "[A-Za-z]"), F.lit(1.0))
    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]", "U"), "[a-z]", "L"), "[0-9]", "D"), "[^ULD]", "O"), "", "")
    return found.withColumn("__kinds", kinds).withColumns({
        "length": size, "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "upper": count(c, "[A-Z]") / size, "lower": count(c, "[a-z]") / size, "digit": count(c, "[0-9]") / size, "other": count(c, "[^A-Za-z0-9]") / size,
        "runs": count("__kinds", "(.)(?!\\1)") / size, "stay_letter": count("__kinds", "L(?=L)|U(?=U)") / pairs, "stay_digit": count("__kinds", "D(?=D)") / pairs,
        "letter_digit": count("__kinds", "[LU](?=D)") / pairs, "digit_letter": count("__kinds", "D(?=[LU])") / pairs, "lower_upper": count("__kinds", "L(?=U)") / pairs,
        "hex": yes(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "covered": 1 - count(F.regexp_replace(low, "(" + "|".join(sorted(WORDS, key=lambda w: -len(w))) + ")", ""), "[a-z]") / letters,
        "assigned": yes(before.rlike("[:=]\\s*[\"'`]?$")), "quoted": yes(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "near": yes(before.rlike(NEAR)), "fake": yes(before.rlike(FAKE) | after.rlike(FAKE) | c.rlike(FAKE)), "plain": yes(before.rlike(PLAIN)), "odd_path": yes(F.coalesce("path", F.lit("")).rlike(PATHS)), "called": yes(after.rlike(r"^[(.\[]")),
    }).drop("__kinds")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n labelled findings by rule: keys and passwords of several forms, and what is taken for them."""
    h = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256)
    words = F.array(*[F.lit(w) for w in WORDS])
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    pick = lambda options, k: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(options))) + 1).cast("int"))
    plain = F.concat(word(11), F.lit(" "), word(12), F.lit(" "))
    base64 = F.regexp_replace(F.base64(F.unhex(h(3))), "[^A-Za-z0-9]", "")
    base32 = F.translate(F.upper(h(1)), "0189EF", "GHJKLM")
    digits = F.translate(h(2), "abcdef", "012345")
    cap = F.initcap(word(13))
    part = lambda n, k: F.substring(h(k), 1, n)
    letters = F.regexp_replace(F.translate(base64, "0123456789", "qwxzjkvyhu"), "^$", "q")
    made = F.translate(F.lower(letters), "0123456789qxz", "etaoinshrdaeo")
    some = lambda text, least, most, k: F.substring(text, F.lit(1), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(most - least + 1)) + least).cast("int"))
    secret = pick(("password=", "passwd: ", "pwd = \"", "\"password\": \"", "secret=", "api_key: '", "token = "), 30)
    other = pick(("name = ", "type: ", "count=", "\"title\": \"", "level = '", "note: ", "x := "), 31)
    kinds = [
        (1, F.concat(plain, pick(("token = \"", "api_key: \"", "secret=\"", "auth token '"), 1)), part(40, 4), F.lit("\" ")),
        (1, F.concat(plain, pick(("password=", "passwd: ", "pwd=", "password = '"), 2)), part(18, 5), F.concat(F.lit(" "), word(14))),
        (1, plain, F.concat(pick(("AKIA", "ASIA"), 3), F.substring(base32, 1, 16)), F.concat(F.lit(" "), word(15))),
        (1, F.concat(plain, pick(("secret: ", "access_key=", "Bearer ", "private key "), 4)), F.substring(base64, 1, 32), F.lit("\n")),
        (1, F.concat(plain, pick(("", "key ", "use "), 5)), F.concat(pick(("sk_live_", "ghp_", "xoxb-"), 6), F.substring(base64, 1, 30)), F.lit(" ")),
        (0, F.concat(plain, pick(("commit ", "sha256: ", "checksum ", "revision "), 7)), part(40, 6), F.lit(" ")),
        (0, F.concat(plain, pick(("id ", "uuid: ", "", "order "), 8)), F.concat_ws("-", part(8, 7), part(4, 8), part(4, 9), part(4, 10), part(12, 11)), F.lit(" ")),
        (0, plain, F.concat(word(16), cap, F.lit("V"), F.substring(digits, 1, 1), F.initcap(word(17)), F.initcap(word(18))), F.lit("( ")),
        (0, F.concat(plain, pick(("card ", "serial ", "", "account "), 9)), F.substring(digits, 1, 16), F.lit(" ")),
        (0, F.concat(plain, pick(("token = \"", "password=", "api_key: ", "see "), 10)), F.concat(pick(("your_", "example-", "test_", "sample_"), 11), word(19), F.lit("_"), word(20), F.substring(digits, 1, 4)), F.lit("\" ")),
        (0, F.concat(plain, pick(("see ", "path ", "", "url "), 12)), F.concat_ws("/", word(21), F.concat(word(22), F.lit("-v"), F.substring(digits, 1, 1)), F.concat(word(23), F.substring(digits, 2, 2))), F.lit(" ")),
        (0, plain, F.concat_ws("-", F.concat(F.lit("20"), F.substring(digits, 1, 2)), F.substring(digits, 3, 2), F.substring(digits, 5, 2), F.substring(digits, 7, 4)), F.lit(" ")),
        (1, F.concat(plain, secret), F.concat(some(F.lower(letters), 3, 8, 32), some(digits, 1, 4, 33)), F.lit("\n")),
        (1, F.concat(plain, secret), F.concat(some(base64, 2, 8, 34), pick(("&", "!", "@", "#", "$", "%", "*", "^"), 35), some(F.regexp_replace(F.base64(F.unhex(h(36))), "[+/=]", "."), 2, 14, 37)), F.lit(" ")),
        (1, F.concat(plain, secret), some(letters, 7, 40, 38), F.lit("\" ")),
        (1, plain, F.concat(pick(("AKIA", "ASIA"), 39), F.substring(F.translate(base32, "234567", "XYZTUV"), 1, 16)), F.concat(F.lit(" "), word(40))),
        (1, F.concat(plain, pick(("", "key ", "use "), 41)), F.concat(pick(("sk_live_", "ghp_", "xoxb-"), 42), some(letters, 16, 36, 43)), F.lit(" ")),
        (0, F.concat(plain, other), F.concat(pick(("", "", "the", "is", "A"), 44), word(45), some(digits, 0, 3, 46)), F.lit(" ")),
        (0, F.concat(plain, other), F.concat(some(digits, 1, 6, 47), pick(("", ".5", "px", "%", "+1"), 48)), F.lit(", ")),
        (0, F.concat(plain, pick(("secret ", "token ", "password ", "bearer ", "password is "), 49)), pick(("of", "and", "for", "garden", "must", "wrong", "required", "field", "ring", "to", "was"), 50), F.concat(F.lit(" "), word(51))),
        (0, F.concat(plain, secret), pick(("None", "null", "str", "string", "getToken()", "request.token", "${TOKEN}", "os.environ", "self.password", "input()", "True", "<password>", "****", "config.secret", "Optional[str]"), 52), F.lit("\n")),
        (0, F.concat(plain, other), F.concat(pick(("get", "self.", "https://", "", "("), 53), word(54), pick((".", "(", "_", "/"), 55), word(56), pick(("", ")", "()", "[0]"), 57)), F.lit("\n")),
        # Names that no dictionary holds, and secrets of several words.
        (0, F.concat(plain, pick(("return ", "self.", "new ", "call ", ""), 58)), F.concat(some(made, 3, 8, 59), F.initcap(some(F.reverse(made), 3, 8, 60)), pick(("V", "", "Id"), 61), some(digits, 1, 2, 62), F.initcap(some(F.translate(made, "aeiou", "uoiea"), 3, 8, 63))), pick(("(", ".", "(x)", "[", " "), 64)),
        (0, F.concat(plain, pick(("return ", "= ", "import ", ""), 65)), F.concat_ws("_", some(made, 3, 8, 66), some(F.reverse(made), 3, 8, 67), some(digits, 1, 3, 68)), pick(("(", ".", ", ", " "), 69)),
        (1, F.concat(plain, secret), F.concat_ws("-", some(made, 4, 7, 71), some(F.reverse(made), 4, 7, 72), some(F.translate(made, "aeiou", "uoiea"), 4, 7, 73), some(F.translate(F.reverse(made), "aeiou", "oueia"), 3, 6, 74)), F.lit("\" ")),
        # Times: the run up to the hour, and what follows its colons.
        (0, F.concat(plain, pick(("at ", "date: ", "", "since "), 75)), F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-0"), F.substring(digits, 3, 1), F.lit("-1"), F.substring(digits, 4, 1), F.lit("T"), F.substring(digits, 5, 2)), F.concat(F.lit(":"), F.substring(digits, 7, 2), F.lit(":00Z"))),
        (0, F.concat(plain, F.lit("20"), F.substring(digits, 1, 2), F.lit("-0"), F.substring(digits, 3, 1), F.lit("-12T0"), F.substring(digits, 4, 1), F.lit(":"), F.when(F.col("id") % 2 == 0, "").otherwise("30:")), F.concat(F.substring(digits, 5, 2), F.when(F.col("id") % 2 == 0, ":15").otherwise(""), pick(("Z", "", "+02", ".250Z"), 76)), F.lit("\n")),
    ]
    kind = F.col("id") % len(kinds)
    rows = spark.range(0, n, 1, 1)
    pickk = lambda j: F.coalesce(*[F.when(kind == k, F.lit(x[j]) if j == 0 else x[j]) for k, x in enumerate(kinds)])
    path = pick(("src/main", "src0", "app/config", "", "tests/unit", "docs/guide"), 13)
    return rows.select("id", pickk(0).cast("double").alias("label"), pickk(1).alias("before"), pickk(2).alias("candidate"), pickk(3).alias("after"), path.alias("path"))


def train(findings: DataFrame) -> PipelineModel:
    """The forest of labelled findings (candidate, before, after, path, label)."""
    ready = with_features(findings.filter(F.col("candidate").isNotNull() & F.col("label").isNotNull()))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    model: RandomForestClassificationModel = forest.fit(vectors.transform(ready))
    return PipelineModel([vectors, model])


def with_starts(pieces: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """For each array of texts the sums of all lengths before each of them, as ``<name>_at``. Blocks of STRIDE are summed first, so n texts cost n times STRIDE steps,
    not n squared. Each step is a column of its own: what a lambda holds is computed again for every element."""
    zero = F.lit(0).cast("long")

    def sums(x: Column, first: Column) -> Column:
        return F.aggregate(x, F.array(first), lambda done, y: F.concat(done, F.array(F.element_at(done, -1) + y)))

    def block(x: str, k: Column) -> Column:
        return F.transform(F.sequence(k, F.least(k + STRIDE, F.size(x)) - 1), lambda i: F.get(x, i))

    def firsts(x: str) -> Column:
        return F.sequence(F.lit(0), F.size(x) - 1, F.lit(STRIDE))

    def block_sums(x: str) -> Column:
        return sums(F.transform(firsts(x), lambda k: F.aggregate(block(f"{x}_n", k), zero, lambda s, y: s + y)), zero)

    def starts(x: str) -> Column:
        return F.flatten(F.transform(firsts(x), lambda k, j: F.slice(sums(block(f"{x}_n", k), F.get(f"{x}_sum", j)), F.lit(1), F.least(F.lit(STRIDE), F.size(x) - k))))

    out = pieces.withColumns({f"{x}_n": F.transform(x, lambda y: F.char_length(y).cast("long")) for x in names})
    out = out.withColumns({f"{x}_sum": block_sums(x) for x in names}).withColumns({f"{x}_at": starts(x) for x in names})
    return out.drop(*[f"{x}{end}" for x in names for end in ("_n", "_sum")])


def hinted(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [text.contains(":"), text.contains("="), *[low.contains(w) for w in HINTS]])


def candidates(docs: DataFrame, text: str = "text", path: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """A row for each candidate: doc_id, path, ordinal (of the document's pieces), start (characters from 0), candidate, before, after."""
    t, size = F.col("t"), F.char_length
    own = Taken(docs)
    some = own.rows.select(F.col(own.at(doc_id)).alias("doc_id"), F.col(own.at(path)).cast("string").alias("path"), F.translate(text_of(own.at(text)), SPACES, "  ").alias("t")).withColumn("hinted", hinted(t)).filter(t.rlike(START) | F.col("hinted"))
    marked = F.when(F.col("hinted"), F.regexp_replace("t", VALUE, f"$0{MARK}"))
    bare = lambda x: F.replace(x, F.lit(MARK), F.lit(""))
    # Pieces before runs, before marks, and before the words that hold marks.
    cut = some.withColumn("m", marked).select("doc_id", "path", "t", F.split("t", START).alias("p"), F.coalesce(F.split("m", MARK), F.array("t")).alias("v"), "m", F.coalesce(F.split("m", MARKED_WORD), F.array(F.lit(""))).alias("words"))
    cut = cut.withColumn("w", F.transform("words", bare)).withColumn("marks", F.transform("words", lambda x: size(x) - size(bare(x))))
    # For each mark the length of a quoted value after it.
    cut = cut.withColumn("quoted", F.transform(F.regexp_extract_all(F.coalesce("m", F.lit("")), F.lit(rf"{MARK}(?=({QUOTED}))"), F.lit(1)), lambda x: size(bare(x))))
    cut = with_starts(cut, ("p", "v", "w"))
    # For each mark the place where an unquoted value ends.
    ends = F.zip_with("w", "w_at", lambda x, at: at + size(F.regexp_replace(F.regexp_extract(x, r"^\S*", 0), CLOSING, "")))
    cut = cut.withColumn("stop", F.flatten(F.zip_with(ends, "marks", lambda at, n: F.array_repeat(at, n))))

    # Beside the pieces, which begin with the one before the first mark: in a lambda these columns would be made again for every piece.
    of_marks = [F.concat(F.array(F.lit(0)), F.col(x)).alias(x) for x in ("quoted", "stop")]

    def found(pieces: str, kind: int, candidate, more: Sequence[Column] = ()) -> Column:
        z = F.arrays_zip(F.col(pieces).alias("piece"), F.col(f"{pieces}_at").alias("start"), *more)

        def one(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.right(F.get(pieces, k - 1), F.lit(AROUND))).otherwise("")
            length, after = candidate(x, k, before)
            return F.struct(x["start"].alias("start"), length.cast("long").alias("length"), F.lit(kind).alias("kind"), before.alias("before"), after.alias("after"))

        return F.filter(F.transform(z, one), lambda x: x["length"] > 0)

    def run(x: Column, k: Column, before: Column) -> tuple[Column, Column]:
        c = F.regexp_extract(x["piece"], CANDIDATE, 0)
        return size(F.when(c.rlike(rf"[0-9]|^{KNOWN}"), c).otherwise("")), F.substring(x["piece"], size(c) + 1, F.lit(AROUND))

    def value(x: Column, k: Column, before: Column) -> tuple[Column, Column]:
        quoted = F.right(before, F.lit(1)).isin("\"", "'", "`")
        return F.when(k > 0, F.when(quoted, x["quoted"]).otherwise(x["stop"] - x["start"])), F.lit(None).cast("string")

    both = cut.select("doc_id", "path", "t", F.sort_array(F.concat(found("p", 0, run), found("v", 1, value, of_marks))).alias("z"))
    # Of alike ones, which stand side by side now, the run stays.
    fresh = F.filter("z", lambda x, k: (k == 0) | (F.get("z", k - 1)["start"] != x["start"]) | (F.get("z", k - 1)["length"] != x["length"]))
    got = both.select("doc_id", "path", "t", fresh.alias("z"))
    # An inner explode would infer a filter on the size of z, push it to the scan and make every candidate twice there.
    # Pieces are counted from the text before the first candidate, if there is any.
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("z") - 1, F.lit(0)), F.lit(STRIDE)), lambda k: F.slice("z", k + 1, F.lit(STRIDE)))
    got = got.withColumn("shift", (F.get("z", F.lit(0))["start"] > 0).cast("int")).select("doc_id", "path", "t", "shift", F.posexplode_outer(parts).alias("block", "part"))
    # The stretch of the text that the candidates of a part need, and each one's own of it.
    low = F.get("part", F.lit(0))["start"]
    high = F.array_max(F.transform("part", lambda x: x["start"] + x["length"])) + AROUND
    got = got.select("doc_id", "path", "shift", "block", low.alias("low"), F.substring(t, (low + 1).cast("int"), (high - low).cast("int")).alias("body"), "part")
    got = got.select("doc_id", "path", "shift", "block", "low", "body", F.posexplode_outer("part").alias("k", "c")).filter(F.col("c").isNotNull())
    at, end = (x.cast("int") for x in (F.col("c.start") - F.col("low"), F.col("c.start") - F.col("low") + F.col("c.length")))
    after = F.coalesce("c.after", F.substring("body", end + 1, F.lit(AROUND)))
    return got.select("doc_id", "path", (F.col("block") * STRIDE + F.col("k") + F.col("shift")).alias("ordinal"), F.col("c.start").cast("int").alias("start"), "c.before", F.substring("body", at + 1, F.col("c.length").cast("int")).alias("candidate"), after.alias("after"))


def scan(docs: DataFrame, model: PipelineModel, threshold: float = 0.5, **columns) -> DataFrame:
    """Candidates with probability and is_secret."""
    scored = model.transform(with_features(candidates(docs, **columns)))
    chance = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return scored.withColumn("chance", chance).select("doc_id", "path", "ordinal", "start", "candidate", "before", "after", F.col("chance").alias("probability"), (F.col("chance") >= threshold).alias("is_secret"))


def op1(spark, sf_dir: str) -> DataFrame:
    """A row for each candidate of each document: doc_id, ordinal, start, length, candidate_sha256, probability, is_secret."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan(docs, train(labelled_findings(spark)))
    return found.select("doc_id", "ordinal", "start", F.char_length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")
