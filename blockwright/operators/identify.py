"""Search of an image for a unit's identifiers: serial numbers, device names and network addresses in all forms they are written in."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Shorter identifiers meet by chance (fixed value).
LEAST_LENGTH = 6
#: Most forms, and bytes of them, that a search takes to its tasks at once; a longer list is searched in parts of the same scan.
MOST_FORMS, MOST_BYTES = 1 << 17, 16 << 20
HITS = "identifier string, form string, offset long"


def network_address(text: str | None) -> str | None:
    """Twelve hexadecimal digits, however parted, as AA:BB:CC:DD:EE:FF; null if it is no such address."""
    digits = re.sub(r"[\s:.-]", "", text or "").upper()
    return ":".join(re.findall("..", digits)) if re.fullmatch("[0-9A-F]{12}", digits) else None


def forms(identifiers: list[tuple[str, str]]) -> list[tuple[str, str, bytes]]:
    """(identifier, form, bytes) of (kind, value) pairs: text as it is; an address with colons, hyphens, without either, and as six bytes. Short, null or unwritable values have none."""
    out = []
    for kind, value in identifiers:
        if kind == "mac":
            if address := network_address(value):
                pairs = address.split(":")
                out += [(address, f"text joined by {n}", s.join(pairs).encode()) for n, s in (("colons", ":"), ("hyphens", "-"), ("nothing", ""))] + [(address, "bytes", bytes.fromhex("".join(pairs)))]
        elif value and len(value.strip()) >= LEAST_LENGTH and value.isascii():
            out.append((value.strip(), "text", value.strip().encode()))
    return out


def _automaton(found: dict[str, list[int]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for pattern, which in found.items():
        made.add_word(pattern, (len(pattern), which))
    made.make_automaton()
    return made


def identifier_hits(blocks: DataFrame, wanted: list[tuple[str, str, bytes]]) -> DataFrame:
    """(identifier, form, offset) of written forms in blocks (offset, content, before, after), each find once, where it starts.

    Texts are found in either case and as whole tokens: no ASCII letter or digit stands beside them. Six bytes are found
    anywhere. Blocks need one byte of ``before`` and as many of ``after`` as the longest form has. All forms are looked for
    in one pass, by automata whose size is checked; a longer list takes more automata, one after the other, over the same
    bytes. Forms may overlap one another and repeat.
    """
    parts: list[list[int]] = [[]]
    size = 0
    for k, (_, _, pattern) in enumerate(wanted):
        if parts[-1] and (len(parts[-1]) >= MOST_FORMS or size + len(pattern) > MOST_BYTES):
            parts.append([])
            size = 0
        parts[-1].append(k)
        size += len(pattern)

    def run(batches):
        machines = []
        for part in parts:
            kinds: tuple[dict, dict] = ({}, {})  # texts in small letters, bytes as they are
            for k in part:
                raw = wanted[k][1] == "bytes"
                kinds[raw].setdefault((wanted[k][2] if raw else wanted[k][2].lower()).decode("latin-1"), []).append(k)
            machines.append([_automaton(x) if x else None for x in kinds])
        for batch in batches:
            names, kinds_, places = [], [], []
            for offset, content, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                back = (before or b"")[-1:]
                data = back + content + (after or b"")
                views = (data.lower().decode("latin-1"), data.decode("latin-1"))
                for texts, raws in machines:
                    for machine, view in ((texts, views[0]), (raws, views[1])):
                        for end, (length, which) in machine.iter(view) if machine else ():
                            start = end + 1 - length
                            if not len(back) <= start < len(back) + len(content):
                                continue
                            if machine is texts and (data[max(0, start - 1) : start].isalnum() or data[end + 1 : end + 2].isalnum()):
                                continue
                            for k in which:
                                names.append(wanted[k][0])
                                kinds_.append(wanted[k][1])
                                places.append(offset + start - len(back))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds_, pa.string()), pa.array(places, pa.int64())], ["identifier", "form", "offset"])

    return blocks.select("offset", "content", "before", "after").mapInArrow(run, HITS)


def identifier_report(spark: SparkSession, hits: DataFrame, wanted: list[tuple[str, str, bytes]], told: int = 8) -> DataFrame:
    """(identifier, form, n, first): every form with the number of its finds and its first ``told`` places; forms that were not found have none."""
    asked = spark.createDataFrame([Row(identifier=i, form=f) for i, f in sorted({w[:2] for w in wanted})], "identifier string, form string")
    ranked = hits.groupBy("identifier", "form", F.floor(F.col("offset") / (1 << 30)).alias("_g")).agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("offset")), 1, told).alias("p"))
    by = ranked.groupBy("identifier", "form").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, told).alias("first"))
    return asked.join(by, ["identifier", "form"], "left").select("identifier", "form", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("first", F.array().cast("array<bigint>")).alias("first"))
