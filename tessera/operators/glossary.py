"""Glossaries of terms, and where texts use them.

A few terms are matched by one regular expression that stays in the JVM; which term a match is comes from an equality join
of the few distinct matched strings with the terms' written forms.  Thousands are matched by an automaton.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators.automaton import count_terms
from tessera.operators.spread import by_join
from tessera.operators.terms import ranked_keys, term_pattern, written_forms
from tessera.sources.shared import in_arrow

# Words too common to be checked or suggested unless a paper's own glossary lists them.
GENERIC = (
    "abstract introduction background method approach experiment result discussion conclusion limitation contribution "
    "evaluation metric variable set function limit series graph tree stack queue market edge cell agent environment label "
    "layer weight mean rank basis norm node stock bond capital labor supply demand firm organ sequence dimension training "
    "parameter feature memory library treatment policy prediction token approximation equation definition proof profit "
    "revenue disease patient symptom species tissue dose welfare utility bias inference population theorem lemma "
    "proposition corollary conjecture axiom hypothesis assumption simulation survey references appendix acknowledgments "
    "reward empirical theoretical investment asset household therapy diagnosis protocol privacy database precision recall "
    "sensitivity similarity exploration exploitation constraint integral baseline benchmark chronic acute incidence "
    "incentive equilibrium inequality convergence liability"
).split()
PAPER = "paper"
#: Terms up to which one pattern serves, and signs of all terms that may be sent to every task.
FEW, MOST_SIGNS = 64, 1 << 26
#: Signs of all terms up to which tasks hold an automaton of them; it takes about 100 bytes a sign.
HELD_SIGNS = 1 << 18


def merge_layers(layers: DataFrame) -> DataFrame:
    """One entry for each term in lower case: the last row of the last layer (``prec``) wins as a whole."""
    order = Window.partitionBy("key").orderBy(F.desc("prec"), F.desc("row"))
    keyed = layers.withColumn("key", F.lower("en"))
    return keyed.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "row", "prec")


def matcher(terms: list[str]) -> str:
    return r"(?iU)(?<![\w-])(?:" + "|".join(map(term_pattern, ranked_keys(terms))) + r")(?![\w-])"


def listed(glossary: DataFrame) -> list[str]:
    """The terms of a glossary on the driver, after their number and length were checked there."""
    size = glossary.agg(F.sum(F.char_length("en")).alias("n")).first()["n"] or 0
    if size > MOST_SIGNS:
        raise ValueError(f"the glossary's terms have {size} signs; at most {MOST_SIGNS} can be sent to every task")
    return [r.en for r in glossary.select("en").distinct().collect()]


def find_terms(texts: DataFrame, terms: list[str], *ids: str, text_col: str = "text") -> DataFrame:
    """``*ids, key, n, first_pos``: how often each text has each term, counting leftmost matches without overlaps, so a
    longer term hides a shorter one in it; ``first_pos``: the number of its first match among all of the text's, from 0.

    Up to ``FEW`` terms are one pattern in the JVM; more are an automaton that is broadcast (``listed`` checks the size).
    Both give the same.  Texts that repeat their ids are counted together; null texts have no terms."""
    if not ranked_keys(terms):
        return texts.select(*ids, F.lit("").alias("key"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("first_pos")).where("false")
    return _by_pattern(texts, terms, *ids, text_col=text_col) if len(terms) <= FEW else by_automaton(texts, terms, *ids, text_col=text_col)


def find_listed(texts: DataFrame, glossary: DataFrame, *ids: str, text_col: str = "text") -> DataFrame:
    """``find_terms`` for the terms of a glossary of any size: one that is too large for tasks to hold is joined with the texts."""
    size = glossary.agg(F.sum(F.char_length("en")).alias("n")).first()["n"] or 0
    if size > HELD_SIGNS:
        return by_join(texts, glossary, *ids, text_col=text_col)
    return find_terms(texts, [r.en for r in glossary.select("en").distinct().collect()], *ids, text_col=text_col)


def by_automaton(texts: DataFrame, terms: list[str], *ids: str, text_col: str = "text") -> DataFrame:
    """``find_terms`` by ``tessera.operators.automaton``: counted where the texts are; only counts are shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*ids).schema)
    counted = in_arrow(texts.select(*ids, F.col(text_col)), count_terms, f"{named}, key string, n bigint, first_pos int", shared)
    return counted.groupBy(*ids, "key").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))


def _by_pattern(texts: DataFrame, terms: list[str], *ids: str, text_col: str) -> DataFrame:
    spark = texts.sparkSession
    rows = [(t.lower(), k, form, f"(?iU)^(?:{term_pattern(t)})$") for k, t in enumerate(ranked_keys(terms)) for form in written_forms(t)]
    forms = spark.createDataFrame(rows, "key string, rank int, form string, pattern string")
    found = texts.select(*ids, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(matcher(terms)), F.lit(0))).alias("pos", "match"))
    form = F.regexp_replace(F.lower("match"), r"(?U)[\s\-]+", "")
    named = found.select("match").distinct().withColumn("form", form).join(forms, "form").where(F.expr("match rlike pattern")).groupBy("match").agg(F.min_by("key", "rank").alias("key"))
    return found.join(named, "match").groupBy(*ids, "key").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def _marked(text: Column) -> Column:
    """Every word between two signs, of its start and of its end."""
    return F.regexp_replace(text, r"(?U)(\w+)", "\x01$1\x02")


def variant_hits(variants: Column, key: Column) -> Column:
    """Which variants (by index) a text has, as whole words of the normalised forms; ``key``: ``term_key`` of the text.

    Words of both are marked by one fixed pattern, and a variant is searched for literally: no pattern is made for a row.
    Where a variant starts or ends with a sign that is no word, places beside a word don't count."""
    def hit(v: Column, text: Column) -> Column:
        part = _marked(T.term_key(v, True))
        open_start = F.when(part.startswith("\x01"), text).otherwise(F.replace(text, F.concat(F.lit("\x02"), part), F.lit("\x03")))
        open_end = F.when(part.endswith("\x02"), open_start).otherwise(F.replace(open_start, F.concat(part, F.lit("\x01")), F.lit("\x03")))
        return F.contains(open_end, part)

    places = F.transform(F.array(_marked(key)), lambda text: F.filter(F.transform(variants, lambda v, i: F.when(hit(v, text), i)), lambda i: i.isNotNull()))
    return places[0]


def has_term(term: Column, text: Column) -> Column:
    """Whether a text has a term in any case, not behind a sign of a word or a hyphen; what follows is open.  Both are marked
    by one fixed pattern at all such places."""
    marked = lambda x: F.regexp_replace(F.lower(x), r"(?U)(?<![\w-])", "\x01")
    return F.contains(marked(text), F.rtrim(marked(term), F.lit("\x01")))


def only_in_names(term: Column, text: Column) -> Column:
    """Whether a text has a term only inside names: each time capitalised, and the word before (or the last piece of a
    hyphened one), however far, a capitalised ASCII word.  Each match is looked at with what stands between it and the one before."""
    quoted = F.regexp_replace(term, r"([\\.\[\]{}()*+\-?^$|])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iU)(?<![\w-])"), quoted, F.lit(r"\w*"))
    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.call_function("split", text, pattern, F.lit(-1)).alias("between"))

    def named(x: Column, i: Column) -> Column:
        before = F.when(i == 0, x["between"][0]).otherwise(F.concat(x["found"][F.greatest(i - 1, F.lit(0))], x["between"][i]))
        word = F.regexp_extract(before, r"(?U)([\w-]++)[^\w-]*+$", 1)
        return x["found"][i].rlike(r"^\p{Lu}") & word.rlike(r"^[A-Z][A-Za-z0-9_-]*$")

    every = lambda x: F.forall(F.sequence(F.lit(0), F.size(x["found"]) - 1), lambda i: named(x, i))
    return F.element_at(F.transform(F.array(both), lambda x: F.when(F.size(x["found"]) > 0, every(x)).otherwise(F.lit(False))), 1)


def is_generic() -> Column:
    return F.col("key").isin(*GENERIC) & (F.col("source") != PAPER)


def lookup(texts: DataFrame, glossary: DataFrame, *ids: str, include_generic: bool = False, domains: set[str] | None = None) -> DataFrame:
    """The glossary's entries that each text has, with counts: commonest first, then by first place.  Null texts have none;
    texts that repeat their ids are one; an empty glossary or table gives no row."""
    found = find_listed(texts, glossary, *ids).join(glossary, "key")
    if not include_generic:
        found = found.where(~is_generic())
    if domains:
        found = found.where(F.col("domain").isin(*domains) | (F.col("source") == PAPER))
    return found.orderBy(*ids, F.desc("n"), "first_pos", "key")


def new_terms(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Found entries that a paper's glossary lacks, with their preferred variant alone."""
    return found.join(existing.select(F.lower("en").alias("key")), "key", "left_anti").select("key", "en", F.slice("vi", 1, 1).alias("vi"), "domain", "note")


def show(glossary: DataFrame, query: str, most: int = 40) -> DataFrame:
    """Entries that have a text in the term or in a variant: the term itself first, then shorter ones; of
    equal length by term.  At most ``most`` rows are kept in any task; an empty query fits every entry."""
    asked = T.term_key(F.lit(query), True)
    hit = F.lower("en").contains(asked) | F.exists("vi", lambda v: T.term_key(v, True).contains(asked))
    return glossary.where(hit).orderBy(F.lower("en") != asked, F.char_length("en"), "en").limit(most)


def export(glossary: DataFrame) -> DataFrame:
    """Rows of a glossary file, sorted."""
    return glossary.orderBy(F.lower("en")).select("en", F.array_join("vi", "|").alias("vi"), "domain", "note")


def as_table(glossary: DataFrame) -> DataFrame:
    """A Markdown line for each entry."""
    other = F.array_join(F.slice("vi", 2, 1000), ", ")
    where = F.concat("domain", F.when(F.col("source") == PAPER, F.lit(" (paper)")).otherwise(F.lit("")))
    return glossary.select("en", F.concat(F.lit("| "), "en", F.lit(" | "), F.col("vi")[0], F.lit(" | "), other, F.lit(" | "), where, F.lit(" |")).alias("line"))
