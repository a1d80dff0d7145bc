"""Registry triples from N-Triples text or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: one N-Triples statement: subject, predicate, then IRI, blank node or literal with language or type.
_STATEMENT = (
    r"^\s*(?:<([^<>\s]*)>|(_:\S+))\s+<([^<>\s]*)>\s+"
    r'(?:<([^<>\s]*)>|(_:\S+)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\s]*)>)?)\s*\.\s*(?:#.*)?$'
)
# Fixed value: what an IRI must not hold as such; the backslash comes first, as the others are written with it.
_NOT_IN_IRIS = '\\ <>"{}|^`'
_NOTHING = r"^\s*(?:#.*)?$"
_CODE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"


def _unicode(text: Column) -> Column:
    """Both lengths of numbered escapes as the characters they stand for."""

    def character(code: Column) -> Column:
        number = F.unhex(F.lpad(F.substring(code, 3, 8), 8, "0"))
        return F.decode(number, "UTF-32")

    between = F.split(text, _CODE, -1)
    characters = F.transform(F.regexp_extract_all(text, F.lit(_CODE), 0), character)
    pieces = F.zip_with(between, F.concat(characters, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(text.rlike(_CODE), F.array_join(pieces, "")).otherwise(text)


def _plain(text: Column) -> Column:
    """Short escapes as the characters they stand for.

    A doubled backslash must not take part in another escape, so it is set aside
    under a character that N-Triples forbids; :func:`_backslashes` puts it back
    after numbered escapes are read.
    """
    out = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    for written, meant in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f")):
        out = F.replace(out, F.lit(written), F.lit(meant))
    return out


def _backslashes(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit("\\"))


def parse_statements(lines: DataFrame, column: str = "value") -> DataFrame:
    """s, p, o of N-Triples lines, with the kind of o (iri, blank, literal), its language and its type.

    What is no statement is in :func:`rejected_lines`.
    """
    text = F.col(column)
    # One match gives all parts: only the literal may hold spaces, and it comes last.
    order = (1, 2, 3, 4, 5, 7, 8, 6)
    taken = F.split(F.regexp_replace(text, _STATEMENT + "(?s:.*)", " ".join(f"${i}" for i in order)), " ", len(order))
    # Each step makes rows of its own, as Spark would else put the text's own formula in place of every mention of it.
    found = lines.select(F.explode(F.when(text.rlike(_STATEMENT), F.array(taken))).alias("_"))
    part = {i: F.element_at("_", at) for at, i in enumerate(order, 1)}
    given = [_plain(part[i]) if i == 6 else F.nullif(part[i], F.lit("")) for i in order]
    plain = found.select(F.inline(F.array(F.struct(*[value.alias(f"_{i}") for i, value in zip(order, given)]))))
    kind = F.when(F.col("_4").isNotNull(), F.lit("iri")).when(F.col("_5").isNotNull(), F.lit("blank")).otherwise(F.lit("literal"))
    target = F.when(kind == "iri", _unicode(F.col("_4"))).when(kind == "blank", F.col("_5"))
    return plain.select(
        F.coalesce(_unicode(F.col("_1")), "_2").alias("s"),
        _unicode(F.col("_3")).alias("p"),
        target.otherwise(_backslashes(_unicode(F.col("_6")))).alias("o"),
        kind.alias("kind"),
        F.col("_7").alias("lang"),
        _unicode(F.col("_8")).alias("datatype"),
    )


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(s, p, o) of N-Triples lines."""
    return parse_statements(lines, column).select("s", "p", "o")


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are neither a statement nor blank nor a comment."""
    text = F.col(column)
    return lines.where(~text.rlike(_STATEMENT) & ~text.rlike(_NOTHING))


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple.

    With the columns of :func:`parse_statements` the lines say the same as those
    read; without them, objects that look like IRIs or blank nodes are written as such.
    """
    escaped = F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\"))
    for meant, written in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(meant), F.lit(written))
    literal = F.concat(F.lit('"'), escaped, F.lit('"'))
    if "kind" in triples.columns:
        kind = F.col("kind")
        literal = F.concat(
            literal,
            F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang"))
            .when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">")))
            .otherwise(F.lit("")),
        )
    else:
        is_iri = F.col("o").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s<>\"]*$")
        kind = F.when(is_iri, F.lit("iri")).when(F.col("o").rlike(r"^_:\S+$"), F.lit("blank")).otherwise(F.lit("literal"))

    def bracketed(column: Column) -> Column:
        for mark in _NOT_IN_IRIS:
            column = F.replace(column, F.lit(mark), F.lit(f"\\u{ord(mark):04X}"))
        return F.concat(F.lit("<"), column, F.lit(">"))

    subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(bracketed(F.col("s")))
    obj = F.when(kind == "iri", bracketed(F.col("o"))).when(kind == "blank", F.col("o")).otherwise(literal)
    return triples.select(F.concat(subject, F.lit(" "), bracketed(F.col("p")), F.lit(" "), obj, F.lit(" .")).alias("value"))


def read_triples(
    spark: SparkSession, path: str | list[str], fmt: str = "ntriples", strict: bool = False, **options
) -> DataFrame:
    """Triples from N-Triples text files, or from a table format with columns s, p, o.

    Lines that are no statement are left out and can be read with
    :func:`rejected_lines`; with ``strict`` the job fails on the first of them.
    """
    if fmt == "ntriples":
        lines = spark.read.options(**options).text(path)
        if strict:
            wrong = ~F.col("value").rlike(_STATEMENT) & ~F.col("value").rlike(_NOTHING)
            failing = F.raise_error(F.concat(F.lit("no N-Triples statement: "), "value"))
            lines = lines.select(F.when(wrong, failing).otherwise(F.col("value")).alias("value"))
        return parse_ntriples(lines)
    return spark.read.options(**options).format(fmt).load(path).select("s", "p", "o")
