"""DuckDB SQL for the queries: the same results by other formulations.

Coverage is counted position by position, every covered position being a row, for the queries of
coverage and of statistics; the queries behind these use the run-length form.  The resolver is an
unrolled loop in linear space with an explicit freeze once an iteration removed nothing.
"""

from __future__ import annotations

from ..operators.ingest import BIT_SCORE, E_VALUE
from ..operators.resolve import ITERATIONS, SCALE
from .adapter import ALIGNMENTS_SQL, MAPPING_SQL

COLUMNS = "queryId, subjectId, percIdentity, alnLength, mismatchCount, gapOpenCount, queryStart, queryEnd, subjectStart, subjectEnd, eVal, bitScore, qlen, slen"
CONTENT = COLUMNS.removeprefix("queryId, ")
STATS = "subjectId, avg_alignment_length, num_alignments, avg_read_length, std_read_length, avg_identity, std_identity, total_covered_bases, total_depth, subject_length, breadth, avg_depth, mean_coverage, std_coverage, depth_evenness"
COV = "subjectId AS reference, avg_depth AS depth_mean, std_coverage AS depth_std, depth_evenness, breadth, num_alignments AS n_alns, avg_read_length, std_read_length AS stdev_read_length, avg_alignment_length, avg_identity, std_identity AS stdev_identity"
DOUBLES = {
    "avg_alignment_length",
    "avg_read_length",
    "std_read_length",
    "stdev_read_length",
    "avg_identity",
    "std_identity",
    "stdev_identity",
    "std_alignment_length",
    "breadth",
    "avg_depth",
    "depth_mean",
    "depth_std",
    "mean_coverage",
    "std_coverage",
    "depth_evenness",
    "coverage_mean",
    "coverage_stdev",
    "coverage_median",
    "coverage",
    "detection",
    "p",
    "breadth_expected",
    "breadth_expected_ratio",
}
PASSES = "depth_evenness <= 1.2 AND breadth >= 0.3"


def rounded(columns: str) -> str:
    """Doubles to six places, sums of them to four."""
    out = []
    for item in columns.split(", "):
        source, _, name = item.rpartition(" AS ")
        source = source or name
        places = 6 if name in DOUBLES else 4 if name == "coverage_sum" else None
        out.append(f"round({source}, {places}) AS {name}" if places else item)
    return ", ".join(out)


class Steps:
    """A WITH clause that grows step by step."""

    def __init__(self):
        self.parts: list[str] = []

    def add(self, name: str, sql: str) -> str:
        self.parts.append(f"{name} AS MATERIALIZED ({sql})")
        return name

    def select(self, sql: str) -> str:
        return "WITH " + ",\n".join(self.parts) + "\n" + sql

    def ingest(self) -> str:
        self.add("alignments", ALIGNMENTS_SQL)
        return self.add("filtered", f"SELECT * FROM alignments WHERE eVal <= {E_VALUE} AND bitScore >= {BIT_SCORE}")

    def dedup(self) -> str:
        self.ingest()
        return self.add("uniq", f"SELECT min(queryId) AS queryId, {CONTENT} FROM filtered GROUP BY {CONTENT}")

    def segments(self, source: str, tag: str) -> str:
        lengths = self.add(
            f"len_{tag}",
            f"""SELECT subjectId, max(slen) AS L, avg(alnLength) AS avg_alignment_length, count(*) AS num_alignments, avg(qlen) AS avg_read_length,
                stddev_pop(qlen) AS std_read_length, avg(percIdentity) AS avg_identity, stddev_pop(percIdentity) AS std_identity, stddev_pop(alnLength) AS std_alignment_length
                FROM {source} GROUP BY subjectId""",
        )
        events = self.add(
            f"ev_{tag}",
            f"""SELECT subjectId, pos, sum(dl) AS dl FROM (
                  SELECT s.subjectId, least(s.subjectStart, t.L - 1) AS pos, 1 AS dl FROM {source} s JOIN {lengths} t ON s.subjectId = t.subjectId
                  UNION ALL SELECT s.subjectId, least(s.subjectEnd, t.L - 1), -1 FROM {source} s JOIN {lengths} t ON s.subjectId = t.subjectId)
                GROUP BY subjectId, pos""",
        )
        return self.add(
            f"seg_{tag}",
            f"""SELECT subjectId, L, avg_alignment_length, pos, coalesce(lead(pos) OVER w, L) AS next_pos,
                sum(dl) OVER (PARTITION BY subjectId ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth
                FROM {events} JOIN {lengths} USING (subjectId) WHERE pos < L WINDOW w AS (PARTITION BY subjectId ORDER BY pos)""",
        )

    def positions(self, source: str, tag: str) -> str:
        """As ``segments``, by counting the alignments over each position."""
        self.segments(source, tag)  # for the lengths
        self.add(
            f"over_{tag}",
            f"""SELECT subjectId, pos, count(*) AS depth FROM (
                  SELECT s.subjectId, unnest(range(CAST(s.subjectStart AS BIGINT), CAST(least(s.subjectEnd, t.L - 1) AS BIGINT))) AS pos
                  FROM {source} s JOIN len_{tag} t ON s.subjectId = t.subjectId)
                GROUP BY subjectId, pos""",
        )
        self.add(
            f"point_{tag}",
            f"""SELECT DISTINCT s.subjectId, t.L, t.avg_alignment_length, unnest([least(s.subjectStart, t.L - 1), least(s.subjectEnd, t.L - 1)]) AS pos
                FROM {source} s JOIN len_{tag} t ON s.subjectId = t.subjectId""",
        )
        return self.add(
            f"by_position_{tag}",
            f"""SELECT p.subjectId, L, avg_alignment_length, p.pos, coalesce(lead(p.pos) OVER (PARTITION BY p.subjectId ORDER BY p.pos), L) AS next_pos, coalesce(depth, 0) AS depth
                FROM point_{tag} p LEFT JOIN over_{tag} o ON p.subjectId = o.subjectId AND p.pos = o.pos""",
        )

    def position_stats(self, source: str, tag: str) -> str:
        """As ``stats``, from single positions."""
        self.positions(source, tag)
        self.add(
            f"sums_{tag}",
            f"""SELECT subjectId, count(*) AS covered, sum(depth) AS total, CAST(sum(depth * depth) AS DOUBLE) AS squares
                FROM over_{tag} JOIN (SELECT subjectId, L, CASE WHEN ceil(avg_alignment_length) + 10 >= L THEN 0 ELSE CAST(ceil(avg_alignment_length) AS BIGINT) + 10 END AS t FROM len_{tag})
                USING (subjectId) WHERE pos >= t AND pos < L - t GROUP BY subjectId""",
        )
        return self.stats(source, tag, f"sums_{tag}")

    def stats(self, source: str, tag: str, sums: str | None = None) -> str:
        segments = f"seg_{tag}" if sums else self.segments(source, tag)
        self.add(
            f"trim_{tag}",
            f"""SELECT *, greatest(0, least(next_pos, L - t) - greatest(pos, t)) AS length FROM (
                  SELECT *, CASE WHEN ceil(avg_alignment_length) + 10 >= L THEN 0 ELSE CAST(ceil(avg_alignment_length) AS BIGINT) + 10 END AS t FROM {segments})""",
        )
        self.add(
            f"cov_{tag}",
            f"""SELECT subjectId, sum(CASE WHEN depth <> 0 THEN length ELSE 0 END) AS covered, sum(depth * length) AS total, CAST(sum(depth * depth * length) AS DOUBLE) AS squares
                FROM trim_{tag} GROUP BY subjectId""",
        )
        self.add(
            f"mean_{tag}",
            f"""SELECT *, total / L AS mean_coverage, sqrt(greatest(CAST(0 AS DOUBLE), squares / L - (total / L) * (total / L))) AS std_coverage
                FROM (SELECT n.*, CAST(coalesce(covered, 0) AS DOUBLE) AS covered, CAST(coalesce(total, 0) AS DOUBLE) AS total, coalesce(squares, 0) AS squares
                      FROM len_{tag} n LEFT JOIN {sums or f"cov_{tag}"} USING (subjectId))""",
        )
        return self.add(
            f"stats_{tag}",
            f"""SELECT subjectId, avg_alignment_length, num_alignments, avg_read_length, std_read_length, avg_identity, std_identity,
                CAST(covered AS BIGINT) AS total_covered_bases, CAST(total AS BIGINT) AS total_depth, L AS subject_length,
                covered / L AS breadth, CASE WHEN covered > 0 THEN total / covered ELSE 0 END AS avg_depth, mean_coverage, std_coverage,
                CASE WHEN mean_coverage > 0 THEN std_coverage / mean_coverage END AS depth_evenness FROM mean_{tag}""",
        )

    def first_pass(self) -> str:
        self.dedup()
        stats = self.stats("uniq", "a")
        return self.add("passed_a", f"SELECT * FROM {stats} WHERE {PASSES}")

    def surviving(self) -> str:
        self.first_pass()
        return self.add("surviving", "SELECT * FROM uniq WHERE subjectId IN (SELECT subjectId FROM passed_a)")

    def weights(self) -> str:
        self.surviving()
        return self.add("i_0", "SELECT *, bitScore / sum(bitScore) OVER (PARTITION BY subjectId) AS p FROM surviving")

    def iteration(self, k: int) -> str:
        frozen = f"OR (SELECT count(*) FROM i_{k - 1}) = (SELECT count(*) FROM i_{k - 2})" if k > 1 else ""
        return self.add(
            f"i_{k}",
            f"""SELECT {COLUMNS}, pn AS p FROM (
                  SELECT *, max(pn) OVER (PARTITION BY queryId) AS mx, count(*) OVER (PARTITION BY queryId) AS nn FROM (
                    SELECT *, p * p / slen / sum(p * p / slen) OVER (PARTITION BY queryId) AS pn FROM i_{k - 1}))
                WHERE nn = 1 OR pn >= {SCALE} * mx {frozen}""",
        )

    def resolved(self) -> str:
        self.weights()
        for k in range(1, ITERATIONS + 1):
            self.iteration(k)
        return self.add("resolved", f"SELECT {COLUMNS} FROM i_{ITERATIONS}")

    def rejoined(self) -> str:
        self.resolved()
        return self.add("rejoined", f"SELECT {COLUMNS} FROM filtered WHERE ({COLUMNS}) IN (SELECT ({COLUMNS}) FROM resolved)")

    def cov_stats(self) -> str:
        self.rejoined()
        stats = self.stats("rejoined", "b")
        return self.add("cov_stats", f"SELECT {COV} FROM {stats} WHERE {PASSES}")

    def genes(self) -> str:
        self.cov_stats()
        self.add("mapping", MAPPING_SQL)
        return self.add("genes", "SELECT * FROM mapping JOIN cov_stats USING (reference)")


def _sql(build: str, columns: str, source: str | None = None) -> str:
    steps = Steps()
    name = getattr(steps, build)()
    return steps.select(f"SELECT {rounded(columns)} FROM {source or name}")


def _stats_sql(tag_source: str, columns: str) -> str:
    steps = Steps()
    steps.dedup()
    steps.position_stats("uniq", "a")
    return steps.select(f"SELECT {rounded(columns)} FROM {tag_source}")


def _one_step() -> str:
    steps = Steps()
    steps.weights()
    steps.iteration(1)
    return steps.select(f"SELECT {rounded('queryId, subjectId, p')} FROM i_1")


def oracle_sql() -> dict[str, str]:
    cov = ", ".join(x.rpartition(" AS ")[2] for x in COV.split(", "))
    groups = """SELECT grp, avg(depth_mean) AS coverage_mean, stddev_samp(depth_mean) AS coverage_stdev, median(depth_mean) AS coverage_median, sum(depth_mean) AS coverage_sum,
        count(*) AS n_genes, avg(avg_read_length) AS avg_read_length, avg(stdev_read_length) AS stdev_read_length, avg(avg_identity) AS avg_identity, avg(stdev_identity) AS stdev_identity FROM genes GROUP BY grp"""
    group_columns = "grp, coverage_mean, coverage_stdev, coverage_median, coverage_sum, n_genes, avg_read_length, stdev_read_length, avg_identity, stdev_identity"
    expected = "subjectId, breadth, mean_coverage, breadth_expected, breadth_expected_ratio"
    with_expected = """(SELECT *, breadth / nullif(breadth_expected, 0) AS breadth_expected_ratio FROM (SELECT *, 1 - exp(-mean_coverage) AS breadth_expected FROM stats_a))"""
    anvio = "reference AS gene_id, replace(grp, 'ko:', '') AS enzyme_accession, 'unknown' AS source, depth_mean AS coverage, breadth AS detection"
    cov_stats, no_multimap = _sql("cov_stats", cov), _sql("cov_stats", COLUMNS, "rejoined WHERE subjectId IN (SELECT reference FROM cov_stats)")
    genes, aggregated, exported = _sql("genes", f"reference, grp, {cov.removeprefix('reference, ')}"), _sql("genes", group_columns, f"({groups})"), _sql("genes", anvio)
    return {
        "ingest_filter": _sql("ingest", COLUMNS),
        "dedup_alignments": _sql("dedup", COLUMNS),
        "align_stats": _stats_sql("len_a", "subjectId, L, avg_alignment_length, num_alignments, avg_read_length, std_read_length, avg_identity, std_identity, std_alignment_length"),
        "coverage_segments": _stats_sql("by_position_a", "subjectId, CAST(pos AS INTEGER) AS pos, CAST(next_pos AS INTEGER) AS next_pos, CAST(depth AS BIGINT) AS depth"),
        "coverage_trimmed": _stats_sql("trim_a", "subjectId, pos, next_pos, CAST(depth AS BIGINT) AS depth, CAST(length AS BIGINT) AS length"),
        "reference_stats": _stats_sql("stats_a", STATS),
        "reference_stats_filtered": _sql("first_pass", STATS),
        "surviving_alignments": _sql("surviving", COLUMNS),
        "resolver_init": _sql("weights", "queryId, subjectId, p"),
        "resolver_one_step": _one_step(),
        "resolve_multimaps": _sql("resolved", COLUMNS),
        "rejoin_alignments": _sql("rejoined", COLUMNS),
        "pipeline_cov_stats": cov_stats,
        "pipeline_no_multimap": no_multimap,
        "gene_abundances": genes,
        "group_abundances": aggregated,
        "anvio_export": exported,
        "command_line_cov_stats": cov_stats,
        "command_line_no_multimap": no_multimap,
        "command_line_genes": genes,
        "command_line_groups": aggregated,
        "command_line_anvio": exported,
        "read_multiplicity": _sql(
            "dedup",
            "count(*) AS n_reads, count(*) FILTER (n = 1) AS unique_reads, count(*) FILTER (n > 1) AS multi_reads, CAST(sum(n) AS BIGINT) AS n_alignments",
            "(SELECT queryId, count(*) AS n FROM uniq GROUP BY queryId)",
        ),
        "distinct_counts": _sql("dedup", "count(DISTINCT queryId) AS n_reads, count(DISTINCT subjectId) AS n_references"),
        "stats_by_breadth": _stats_sql("stats_a", "subjectId, breadth"),
        "evalue_retention": f"""WITH alignments AS MATERIALIZED ({ALIGNMENTS_SQL}), strong AS (SELECT *, -log10(greatest(eVal, 1e-300)) AS strength FROM alignments),
            bound AS (SELECT subjectId, quantile_cont(strength, 0.6) AS bound FROM strong GROUP BY subjectId)
            SELECT {COLUMNS} FROM strong JOIN bound USING (subjectId) WHERE strength >= bound - 1e-9""",
        "union_alignments": _sql("dedup", "subjectId, n", "(SELECT subjectId, count(*) AS n FROM (SELECT subjectId FROM uniq UNION ALL SELECT subjectId FROM alignments) GROUP BY subjectId)"),
        "all_filters": _stats_sql(
            """stats_a WHERE avg_alignment_length >= 25 AND num_alignments >= 3 AND avg_read_length >= 95 AND avg_identity >= 90.5 AND breadth >= 0.2 AND mean_coverage >= 0.25
            AND avg_depth >= 1 AND std_coverage >= 0.3 AND breadth / nullif(1 - exp(-mean_coverage), 0) >= 0.5 AND depth_evenness <= 2""",
            "subjectId",
        ),
        "breadth_expected": _stats_sql(with_expected, expected),
        "read_plain": _sql("ingest", COLUMNS, "alignments"),
        "read_gzip": _sql("ingest", COLUMNS, "alignments"),
        "read_block_gzip": _sql("ingest", COLUMNS, "alignments"),
        "read_wide": _sql("ingest", f"{COLUMNS}, cigar, qaln, taln", "(SELECT *, alnLength || 'M' AS cigar, 'AC\"GT' AS qaln, '' || slen AS taln FROM alignments)"),
        "dedup_from_files": _sql("dedup", COLUMNS),
        "read_mapping_tab": MAPPING_SQL,
        "read_mapping_comma": MAPPING_SQL,
        "write_parts": cov_stats,
        "write_one_file": cov_stats,
        "filters_from_text": _stats_sql("stats_a WHERE breadth >= 0.25 AND num_alignments >= 2 AND depth_evenness <= 1.5", "subjectId"),
    }
