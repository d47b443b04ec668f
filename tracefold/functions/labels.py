"""Scalar expressions over node labels: typing, attributes, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node type letters, shapes of the dot output, and the flow direction of operations.
SHAPES = {"p": "box", "f": "ellipse", "n": "parallelogram"}
INTO_PROCESS = ("read", "recvfrom", "fcntl")
FROM_PROCESS = ("write",)
BETWEEN_PROCESSES = ("execve", "clone")
BOTH_WAYS = ("rename",)

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def node_type(label: Column) -> Column:
    """``p`` for ``name(pid)``, ``n`` for ``ip:port->ip:port``, else ``f``; null stays null."""
    return F.when(label.isNull(), F.lit(None)).when(label.contains("->"), "n").when(label.rlike(r"^[^/]*\([0-9]+\)$"), "p").otherwise("f")


def process_label(name: Column, pid: Column) -> Column:
    return F.concat(name, F.lit("("), pid.cast("string"), F.lit(")"))


def network_label(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    return F.concat(src_ip, F.lit(":"), src_port.cast("string"), F.lit("->"), dst_ip, F.lit(":"), dst_port.cast("string"))


def file_stem(path: Column) -> Column:
    """The path without the last extension of its last component; one extension goes, a dot-file's name too."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def executable(label: Column) -> Column:
    return F.regexp_extract(label, r"^(.*)\([0-9]+\)$", 1)


def pid(label: Column) -> Column:
    return F.regexp_extract(label, r"\(([0-9]+)\)$", 1)


def source_ip(label: Column) -> Column:
    return F.regexp_extract(label, r"^(.*):[0-9]+->", 1)


def target_ip(label: Column) -> Column:
    return F.regexp_extract(label, r"->(.*):[0-9]+$", 1)


def attribute_1(label: Column) -> Column:
    """Executable of a process, empty for a file, source ip of a connection."""
    kind = node_type(label)
    return F.when(kind == "p", executable(label)).when(kind == "n", source_ip(label)).otherwise("")


def attribute_2(label: Column) -> Column:
    """Pid of a process, stem of a file, target ip of a connection."""
    kind = node_type(label)
    return F.when(kind == "p", pid(label)).when(kind == "n", target_ip(label)).otherwise(file_stem(label))


def shape(label: Column) -> Column:
    kind = node_type(label)
    out = F.when(kind == "p", SHAPES["p"])
    for letter in ("f", "n"):
        out = out.when(kind == letter, SHAPES[letter])
    return out


def edge_label(src: Column, dst: Column, op: Column) -> Column:
    return F.concat(src, F.lit("->"), dst, F.lit(": "), op)


def quoted(text: Column) -> Column:
    """A dot string."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def span_text(start_us: Column, end_us: Column) -> Column:
    """``start->end`` in whole seconds, from microseconds since the epoch."""
    show = lambda t: F.date_format(F.timestamp_micros(t), TIME_FORMAT)
    return F.concat(show(start_us), F.lit("->"), show(end_us))
