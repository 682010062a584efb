"""Fill-in-the-middle: counted quantifiers cut a text into prefix, middle and suffix in one match.

All of it is SQL expressions: no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.sources.tables import with_once

#: A unit: a run of ASCII letters, or one other character.
UNIT = "[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of texts that are transformed, and of these the percent whose suffix comes first.
RATE, SPM_RATE = 90, 20
SEED = 1
#: Units are counted so many characters at a time, since a count holds all that it has matched.
PIECE = 1 << 16

_ORDER = {PSM: f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", SPM: f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
_BACK = {PSM: rf"(?s)^{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)$", SPM: rf"(?s)^{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)$"}
_TEXT = {PSM: "$1$3$2", SPM: "$2$3$1"}


def count_units(text: Column) -> Column:
    """How many units a text has: counted by pieces, less the runs of letters that two pieces share."""
    last = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / PIECE).cast("int"))

    def add(total: Column, i: Column) -> Column:
        own = F.regexp_count(F.substring(text, i * PIECE + 1, F.lit(PIECE)), F.lit(UNIT))
        shared = F.substring(text, (i + 1) * PIECE, F.lit(2)).rlike("^[A-Za-z]{2}$")
        return total + own - F.when(shared, 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), last), F.lit(0).cast("bigint"), add)


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 that follow from seed and key: the first groups of eight hex digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def cut_pattern(first: Column, second: Column) -> Column:
    """A pattern whose groups are the first ``first`` units, those up to ``second``, and the rest.

    The counts are possessive: the match neither backtracks nor recurses, however long the text.
    """
    return F.concat(
        F.lit(f"(?s)^((?:{UNIT}){{"), first.cast("string"), F.lit(f"}}+)((?:{UNIT}){{"), (second - first).cast("string"), F.lit("}+)(.*)$")
    )


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each whole text.

    A text of n units is cut at two of its n + 1 places, and prefix, suffix and
    middle (``psm``) or suffix, prefix and middle (``spm``) follow their markers.
    Places and form are drawn from seed and key alone. Texts that are null (taken
    for empty), empty, hold a marker or are not drawn stay as they are: form
    ``plain``, whose two lengths are null. A null key is drawn for like an empty one; repeated rows come
    out alike. Rows are neither moved nor dropped; columns of these names are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    others = [F.col(c) for c in docs.columns if c not in names]
    source = docs.select(*others, F.col(key).alias("_key"), value.alias("_text"))
    counted = with_once(source, "_n", count_units(F.col("_text")))
    h1, h2, h3, h4 = draws(F.col("_key"), seed)
    places = [F.pmod(h, F.col("_n") + 1) for h in (h1, h2)]
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("_text", F.lit(marker))
    plain = (F.col("_text") == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, PLAIN).when(h4 % 100 < spm_rate, SPM).otherwise(PSM)
    drawn = with_once(counted, "_cut", F.struct(form.alias("form"), F.least(*places).alias("first"), F.greatest(*places).alias("second")))
    pattern = cut_pattern(F.col("_cut.first"), F.col("_cut.second"))
    replaced = F.when(F.col("_cut.form") == PLAIN, F.col("_text")).otherwise(
        F.regexp_replace("_text", pattern, F.when(F.col("_cut.form") == SPM, _ORDER[SPM]).otherwise(_ORDER[PSM]))
    )
    made = with_once(drawn, "_output", replaced)
    at = {m: F.locate(m, F.col("_output")) for m in (PREFIX, SUFFIX, MIDDLE)}
    prefix_end = F.when(F.col("_cut.form") == SPM, at[MIDDLE]).otherwise(at[SUFFIX])
    transformed = F.col("_cut.form") != PLAIN
    return made.select(
        *others,
        F.col("_n").alias("n"),
        F.col("_cut.form").alias("form"),
        F.when(transformed, prefix_end - at[PREFIX] - len(PREFIX)).cast("bigint").alias("prefix_chars"),
        F.when(transformed, F.length("_output") - at[MIDDLE] - len(MIDDLE) + 1).cast("bigint").alias("middle_chars"),
        F.col("_output").alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    back = F.when(form == SPM, F.regexp_replace(output, _BACK[SPM], _TEXT[SPM]))
    return back.when(form == PSM, F.regexp_replace(output, _BACK[PSM], _TEXT[PSM])).otherwise(output)
