"""Scan decisions: which profile a device gets, and where a run halts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..data import table
from ..functions.text import ipv4

FAILURES = ("tripped", "errored", "unreachable")
#: (signal, value, profile): what marks a device as fragile or robust. A site passes its own rows.
POLICY = table("scan_policy")


def scan_profile(asset_class: Column, mac_vendor: Column, mdns_services: Column, open_ports: Column, policy: list[dict[str, str]] | None = None) -> Column:
    """``gentle`` or ``standard``: the first signal that speaks decides, and without any the answer is gentle.

    A known asset class speaks first. Then a part of the vendor's name, an advertised service or an open port that marks
    fragile devices; a robust port comes last.
    """
    rows = POLICY if policy is None else policy
    values = lambda signal, profile: [r["value"] for r in rows if (r["signal"], r["profile"]) == (signal, profile)]
    vendor, services = F.lower(F.coalesce(mac_vendor, F.lit(""))), F.transform(mdns_services, F.lower)

    def speaks(signal: str, profile: str) -> Column:
        known = values(signal, profile)
        if not known:
            return F.lit(False)
        if signal == "asset_class":
            return asset_class.isin(*known)
        if signal == "mac_vendor":
            return F.exists(F.array(*map(F.lit, known)), lambda part: F.contains(vendor, part))
        return F.arrays_overlap(services, F.array(*map(F.lit, known))) if signal == "mdns_service" else F.arrays_overlap(open_ports, F.array(*(F.lit(int(v)) for v in known)))

    chain = [("asset_class", "gentle"), ("asset_class", "standard"), ("mac_vendor", "gentle"), ("mdns_service", "gentle"), ("open_port", "gentle"), ("open_port", "standard")]
    return F.coalesce(*[F.when(speaks(*step), step[1]) for step in chain], F.lit("gentle"))


def scan_outcome(events: DataFrame) -> DataFrame:
    """Adds ``outcome`` to rows (run_id, pos, authorized, credentialed, pre_ok, scan_result, post_ok).

    scan_result: ok, timeout or error; a null pre_ok means that the check itself failed. Order of the checks: scope, credentials, health before, the scan, health after.
    """
    outcome = (
        F.when(~F.col("authorized"), "denied")
        .when(F.col("credentialed"), "skipped_credentialed")
        .when(F.col("pre_ok").isNull(), "errored")
        .when(~F.col("pre_ok"), "unreachable")
        .when(F.col("scan_result") == "timeout", "tripped")
        .when(F.col("scan_result") == "error", "errored")
        .when(F.col("post_ok"), "scanned")
        .otherwise("tripped")
    )
    return events.withColumn("outcome", outcome)


def with_halt(outcomes: DataFrame, halt_after: int = 3) -> DataFrame:
    """Adds ``streak`` (failures in a row up to here) and ``reached``: false once a run has had ``halt_after`` in a row.

    A success ends a streak; an unreachable device counts as a failure; denied and credentialed devices leave it as it is.
    """
    run = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when(F.col("outcome") == "scanned", 1).otherwise(0)).over(run)
    rows = outcomes.withColumn("island", island)
    inside = Window.partitionBy("run_id", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.when(F.col("outcome").isin(*FAILURES), 1).otherwise(0)
    rows = rows.withColumn("streak", F.sum(failed).over(inside))
    halts = F.min(F.when((F.col("streak") >= halt_after) & F.col("outcome").isin(*FAILURES), F.col("pos"))).over(Window.partitionBy("run_id"))
    return rows.withColumn("halted_at", halts).withColumn("reached", F.col("halted_at").isNull() | (F.col("pos") <= F.col("halted_at"))).drop("island")


def run_counts(halted: DataFrame) -> DataFrame:
    """Per run: devices by outcome among those reached, and where it halted."""
    names = ["scanned", "denied", "tripped", "unreachable", "errored", "skipped_credentialed"]
    return halted.filter("reached").groupBy("run_id").agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names], F.max("halted_at").alias("halted_at"))


def probe_verdict(errno: Column, known_port: Column) -> Column:
    """What a connection attempt says: up (also if refused), down, unknown; null without a port to try."""
    # Errno names.
    return (
        F.when(~known_port, F.lit(None).cast("string"))
        .when(errno.isNull() | errno.isin("ECONNREFUSED", "ECONNRESET"), "up")
        .when(errno.isin("ETIMEDOUT", "EHOSTUNREACH", "EHOSTDOWN", "ENETUNREACH", "ENETDOWN", "ECONNABORTED"), "down")
        .otherwise("unknown")
    )


# Arguments that no scan may carry, and characters that could chain, redirect, substitute or glob a command.
FORBIDDEN = ("-A", "--version-all", "--script", "-O")
SHELL_CHARACTERS = ";&|><`$(){}[]!*?~\n\r\t\\'\""
#: (profile, position, argument) of a scan, and (kind, command) of the reads an inspection may send.
ARGUMENTS = table("scan_arguments")
READS = table("read_commands")
DISTRESS_CONFIDENCE = 0.9


def scan_command(address: Column, profile: Column, arguments: list[dict[str, str]] | None = None, program: str = "nmap") -> Column:
    """The arguments a profile means for an IPv4 address, as an array; null for a profile or an address that is none."""
    rows = ARGUMENTS if arguments is None else arguments
    if bad := [r["argument"] for r in rows if r["argument"] in FORBIDDEN]:
        raise ValueError(f"forbidden arguments: {bad}")
    out = F.lit(None).cast("array<string>")
    for name in sorted({r["profile"] for r in rows}):
        mine = [r["argument"] for r in sorted(rows, key=lambda r: int(r["position"])) if r["profile"] == name]
        out = F.when(profile == name, F.array(*map(F.lit, [program, *mine, "-oX", "-"]))).otherwise(out)
    target = ipv4(address)
    return F.when(target.isNotNull() & out.isNotNull(), F.array_append(out, target))


def command_fault(command: Column, reads: list[dict[str, str]] | None = None) -> Column:
    """Why a command may not be sent to a device, null if it is one of the reads: nothing else is ever sent."""
    known = [r["command"] for r in (READS if reads is None else reads)]
    verbs = sorted({c.split(" ")[0] for c in known})
    return (
        F.when(command.isNull() | (command == "") | (command != F.btrim(command)), "malformed command")
        .when(F.translate(command, SHELL_CHARACTERS, "") != command, "shell metacharacters")
        .when(~F.split_part(command, F.lit(" "), F.lit(1)).isin(verbs), "verb is not allowed")
        .when(~command.isin(known), "arguments are not allowed")
    )


def distress_observations(outcomes: DataFrame) -> DataFrame:
    """An observation for every device that did not stand its scan: rows (run_id, pos, target, mac, profile, outcome) that tripped."""
    health = F.struct(F.col("target").alias("ip"), F.col("outcome").alias("state"), "profile", "mac")
    return outcomes.filter("outcome = 'tripped'").select(
        "run_id",
        "pos",
        F.lit("device_health").alias("observation_type"),
        F.to_json(health, {"ignoreNullFields": "false"}).alias("payload"),
        F.lit("health_probe").alias("source"),
        F.lit("active_scan").alias("source_type"),
        F.col("target").alias("source_identifier"),
        F.lit("circuit_breaker").alias("collection_method"),
        F.lit(DISTRESS_CONFIDENCE).alias("confidence"),
    )


def inspector_for(has_credential: Column, open_ports: Column, banners: Column, registry: list[tuple[str, list[int], str]] | None = None) -> Column:
    """The first inspector of the registry (name, ports, start of a banner) that a device speaks to; none without a credential."""
    # What marks the one built-in inspector's protocol.
    rows = [("ssh", [22, 2222], "SSH-")] if registry is None else registry
    no = F.lit(False)
    speaks = lambda ports, start: F.coalesce(F.arrays_overlap(open_ports, F.array(*map(F.lit, ports))), no) | F.coalesce(F.exists(banners, lambda b: F.upper(F.btrim(b)).startswith(start)), no)
    return F.when(F.coalesce(has_credential, no), F.coalesce(*[F.when(speaks(ports, start), name) for name, ports, start in rows], F.lit(None).cast("string")))
