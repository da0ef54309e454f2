"""ANSI SQL twins of the queries, built from shared common table expressions.

The SQL follows the definitions row by row (walks, pairs, full windows); the
Spark side uses the forms that scale. Agreement of the two is the check.
"""

from __future__ import annotations

from ..functions.portable import CDF_DENOMINATOR, CDF_NUMERATOR, CDF_REACH

CTES: dict[str, tuple[list[str], str]] = {}
#: CTEs that several others read and that are worked out once.
ONCE: set[str] = set()


def cte(name: str, needs: str, text: str, once: bool = False) -> None:
    CTES[name] = (needs.split(), text)
    if once:
        ONCE.add(name)


def query(needs: str, body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``body`` behind the CTEs it needs (in order of dependency) and extra ones."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for need in CTES[name][0]:
            visit(need)
        done.append(name)

    for name in needs.split():
        visit(name)
    parts = [f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({CTES[n][1]})" for n in done] + [f"{n} AS ({t})" for n, t in extra]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def hash48(*terms: str) -> str:
    text = " || '|' || ".join(f"CAST({t} AS VARCHAR)" for t in terms)
    return f"CAST(concat('0x', substr(md5({text}), 1, 12)) AS BIGINT)"


def unit_hash(*terms: str) -> str:
    return f"(CAST({hash48(*terms)} AS DOUBLE) / 281474976710656.0::DOUBLE)"


def _poly(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_cdf(z: str) -> str:
    x = f"abs({z})"
    tail = (
        f"(CASE WHEN {x} < {CDF_REACH!r}::DOUBLE THEN exp(-{x} * {x} / 2.0::DOUBLE) * {_poly(CDF_NUMERATOR, x)}"
        f" / {_poly(CDF_DENOMINATOR, x)} ELSE 0.0::DOUBLE END)"
    )
    return f"(CASE WHEN {z} > 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END)"


def sigmoid(m: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({m}))))"


# ---- basket --------------------------------------------------------------------

cte(
    "people",
    "",
    "SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
cte(
    "clinical",
    "people",
    """SELECT r_name AS study, CAST(c_custkey AS VARCHAR) AS sample_id,
    CASE WHEN c_acctbal >= 5000 THEN 'R' WHEN c_acctbal >= 0 THEN 'NR' END AS response FROM people""",
)
cte("valid", "clinical", "SELECT * FROM clinical WHERE response IS NOT NULL")
cte(
    "gated",
    "valid",
    "SELECT * FROM valid WHERE study IN (SELECT study FROM valid GROUP BY study HAVING count(*) >= 25)",
)
cte(
    "bought",
    "",
    """SELECT CAST(o_custkey AS VARCHAR) AS sample_id, p_brand AS gene_id, sum(l_quantity) AS qty
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
cte("genes", "", "SELECT DISTINCT p_brand AS gene_id, CAST(substr(p_brand, 7) AS INTEGER) AS k FROM part")
cte(
    "tpm",
    "clinical bought genes",
    """SELECT c.study, c.sample_id, g.gene_id, coalesce(b.qty, 0.0::DOUBLE) AS value
    FROM clinical c CROSS JOIN genes g LEFT JOIN bought b ON b.sample_id = c.sample_id AND b.gene_id = g.gene_id""",
)
cte(
    "logx",
    "tpm gated",
    """SELECT study, sample_id, gene_id, log2(value + 0.001::DOUBLE) AS value FROM tpm SEMI JOIN gated USING (study, sample_id)""",
)


def present_text(source: str, share: float) -> str:
    """Cells of genes that are zero in at most ``share`` of the study's samples."""
    return f"""SELECT * FROM {source} WHERE (study, gene_id) IN (SELECT (study, gene_id) FROM {source} GROUP BY study, gene_id
    HAVING avg(CASE WHEN round(value, 6) = round(log2(0.001::DOUBLE), 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) <= {share}::DOUBLE)"""


cte("expr", "logx", present_text("logx", 0.5))
_MEMBERS = [
    ("S0", "''", "1.0", "''", "k % 5 = 0"),
    ("S1", "''", "1.0", "''", "k % 5 = 1"),
    ("S2", "''", "1.0", "''", "k % 5 = 2"),
    ("S3", "''", "CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END", "''", "k % 5 = 3"),
    ("S4", "''", "1.0", "''", "k % 5 = 4"),
    ("COX", "''", "1.0", "CASE WHEN k <= 5 THEN 'pro' ELSE 'anti' END", "k BETWEEN 1 AND 10"),
    (
        "IPS",
        "''",
        "CASE WHEN k <= 6 OR k BETWEEN 13 AND 18 THEN 1.0 ELSE -1.0 END",
        "CASE WHEN k <= 6 THEN 'MHC' WHEN k <= 12 THEN 'CP' WHEN k <= 18 THEN 'EC' ELSE 'SC' END",
        "k >= 1",
    ),
    ("PIO", "'sensitive'", "1.0", "''", "k % 5 = 0"),
    ("PIO", "'resistant'", "-1.0", "''", "k % 5 = 1"),
    ("IPR", "CAST(k % 3 AS VARCHAR)", "1.0", "''", "k >= 1"),
    ("PAS", "CAST(k % 4 AS VARCHAR)", "1.0", "''", "k % 4 <= 2"),
    (
        "OV",
        "CAST(k % 6 AS VARCHAR)",
        "CASE k % 6 WHEN 0 THEN 0.5 WHEN 1 THEN -0.3 ELSE 0.2 END",
        "''",
        "k % 6 <= 2",
    ),
    ("BAD", "''", "1.0", "''", "k BETWEEN 1 AND 4"),
    ("UNK", "''", "1.0", "''", "k BETWEEN 1 AND 5"),
]
cte(
    "signature",
    "genes",
    " UNION ALL ".join(
        f"SELECT '{s}' AS signature, {sub} AS sub_signature, gene_id, CAST({w} AS DOUBLE) AS weight, {g} AS grp "
        f"FROM genes WHERE {cond}"
        for s, sub, w, g, cond in _MEMBERS
    )
    + " UNION ALL SELECT 'BAD', '', 'Brand#9' || CAST(k - 1 AS VARCHAR), 1.0::DOUBLE, '' FROM genes WHERE k BETWEEN 1 AND 2",
)
cte(
    "sig_info",
    "",
    """SELECT * FROM (VALUES ('S0','GSVA',NULL),('S1','GSVA',NULL),('S2','ssGSEA',NULL),('S3','Weighted Mean',NULL),
    ('S4','ssGSEA',NULL),('COX','Specific Algorithm','cox_is'),('IPS','Specific Algorithm','ips'),
    ('PIO','Specific Algorithm','pio'),('IPR','Specific Algorithm','ipres'),('PAS','Specific Algorithm','passon'),
    ('OV','Specific Algorithm','ipsov'),('BAD','GSVA',NULL),('UNK','No Such Method',NULL)) t(signature, method, algorithm)""",
)
cte(
    "routed",
    "signature sig_info",
    """SELECT s.*, CASE method WHEN 'GSVA' THEN 'gsva' WHEN 'ssGSEA' THEN 'ssgsea' WHEN 'Weighted Mean' THEN 'mean'
    WHEN 'Specific Algorithm' THEN algorithm END AS branch FROM signature s LEFT JOIN sig_info USING (signature)""",
)
cte(
    "sets",
    "routed expr",
    """SELECT e.study, r.signature, r.sub_signature, r.gene_id, r.weight, r.grp, r.branch FROM routed r JOIN (
      SELECT g.study, s.signature FROM (SELECT DISTINCT signature, gene_id, branch FROM routed) s
      JOIN (SELECT DISTINCT study, gene_id FROM expr) g USING (gene_id)
      JOIN (SELECT signature, count(DISTINCT gene_id) AS n FROM routed GROUP BY 1) z USING (signature)
      GROUP BY g.study, s.signature, z.n, s.branch HAVING count(*) / z.n::DOUBLE > 0.8 OR s.branch = 'ips') e USING (signature)
    WHERE r.branch IS NOT NULL""",
)


def gsva_ctes(sets: str, f_sql: str, prefix: str = "gs") -> list[tuple[str, str]]:
    """The walk over all genes, as published. ``f_sql`` yields ``f`` per cell."""
    return [
        (f"{prefix}_f", f_sql),
        (
            f"{prefix}_rank",
            f"""SELECT *, row_number() OVER (PARTITION BY study, sample_id ORDER BY f DESC, gene_id) AS pos,
            count(*) OVER (PARTITION BY study, sample_id) AS p FROM {prefix}_f""",
        ),
        (
            f"{prefix}_walk",
            f"""SELECT r.study, r.sample_id, n.signature, n.sub_signature, r.pos, r.p,
            abs(r.p / 2.0::DOUBLE - r.pos) AS w, s.gene_id IS NOT NULL AS hit
            FROM {prefix}_rank r JOIN (SELECT DISTINCT study, signature, sub_signature FROM {sets}) n USING (study)
            LEFT JOIN {sets} s ON s.study = r.study AND s.signature = n.signature
             AND s.sub_signature = n.sub_signature AND s.gene_id = r.gene_id""",
        ),
        (
            f"{prefix}_nu",
            f"""SELECT study, sample_id, signature, sub_signature,
            sum(CASE WHEN hit THEN w ELSE 0 END) OVER o / sum(CASE WHEN hit THEN w ELSE 0 END) OVER a
            - sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER o / CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER a AS DOUBLE) AS nu
            FROM {prefix}_walk WINDOW a AS (PARTITION BY study, sample_id, signature, sub_signature),
            o AS (PARTITION BY study, sample_id, signature, sub_signature ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
        ),
        (
            f"{prefix}_score",
            f"""SELECT study, sample_id, signature, sub_signature,
            greatest(0.0::DOUBLE, max(nu)) + least(0.0::DOUBLE, min(nu)) AS score FROM {prefix}_nu GROUP BY ALL""",
        ),
    ]


def ssgsea_ctes(expr: str, sets: str, prefix: str = "ss") -> list[tuple[str, str]]:
    return [
        (
            f"{prefix}_rank",
            f"""SELECT *, row_number() OVER (PARTITION BY study, sample_id ORDER BY value DESC, gene_id) AS pos,
            count(*) OVER (PARTITION BY study, sample_id) AS p FROM {expr}""",
        ),
        (
            f"{prefix}_walk",
            f"""SELECT r.study, r.sample_id, n.signature, n.sub_signature, r.pos,
            pow(CAST(r.p - r.pos + 1 AS DOUBLE), 0.25::DOUBLE) AS w, s.gene_id IS NOT NULL AS hit
            FROM {prefix}_rank r JOIN (SELECT DISTINCT study, signature, sub_signature FROM {sets}) n USING (study)
            LEFT JOIN {sets} s ON s.study = r.study AND s.signature = n.signature
             AND s.sub_signature = n.sub_signature AND s.gene_id = r.gene_id""",
        ),
        (
            f"{prefix}_nu",
            f"""SELECT study, sample_id, signature, sub_signature,
            sum(CASE WHEN hit THEN w ELSE 0 END) OVER o / sum(CASE WHEN hit THEN w ELSE 0 END) OVER a
            - sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER o / CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER a AS DOUBLE) AS nu
            FROM {prefix}_walk WINDOW a AS (PARTITION BY study, sample_id, signature, sub_signature),
            o AS (PARTITION BY study, sample_id, signature, sub_signature ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
        ),
        (
            f"{prefix}_raw",
            f"SELECT study, sample_id, signature, sub_signature, sum(nu) AS raw FROM {prefix}_nu GROUP BY ALL",
        ),
        (
            f"{prefix}_score",
            f"""SELECT study, sample_id, signature, sub_signature,
            raw / nullif(max(raw) OVER s - min(raw) OVER s, 0) AS score
            FROM {prefix}_raw WINDOW s AS (PARTITION BY study, signature, sub_signature)""",
        ),
    ]


cte(
    "cume",
    "expr",
    "SELECT *, round(cume_dist() OVER (PARTITION BY study, gene_id ORDER BY value), 9) AS f FROM expr",
)
cte("gs_sets", "sets", "SELECT * FROM sets WHERE branch IN ('gsva', 'pio', 'ipres')")
cte("ss_sets", "sets", "SELECT * FROM sets WHERE branch IN ('ssgsea', 'passon', 'ipsov')")
_gs = gsva_ctes("gs_sets", "SELECT * FROM cume")
_ss = ssgsea_ctes("expr", "ss_sets")
for _i, (_name, _text) in enumerate(_gs):
    cte(_name, "cume gs_sets" if _i == 0 else _gs[_i - 1][0], _text)
for _i, (_name, _text) in enumerate(_ss):
    cte(_name, "expr ss_sets" if _i == 0 else _ss[_i - 1][0], _text)
cte(
    "zexpr",
    "expr",
    """SELECT study, sample_id, gene_id, (value - avg(value) OVER g) / stddev_samp(value) OVER g AS z FROM expr
    WINDOW g AS (PARTITION BY study, gene_id) QUALIFY round(stddev_samp(value) OVER g, 9) > 0""",
)
cte(
    "mean_score",
    "zexpr sets",
    """SELECT study, sample_id, signature, sum(weight * z) / sum(abs(weight)) AS score FROM zexpr
    JOIN sets USING (study, gene_id) WHERE branch = 'mean' GROUP BY ALL""",
)
cte(
    "cox_score",
    "expr sets",
    """SELECT study, sample_id, signature, avg(value) FILTER (grp = 'pro') / nullif(avg(value) FILTER (grp = 'anti'), 0) AS score
    FROM expr JOIN sets USING (study, gene_id) WHERE branch = 'cox_is' GROUP BY ALL""",
)
cte(
    "ips_score",
    "expr sets",
    """SELECT study, sample_id, signature, CASE WHEN az <= 0 THEN 0.0::DOUBLE WHEN az >= 3 THEN 10.0::DOUBLE
    ELSE round(10.0::DOUBLE * az / 3.0::DOUBLE) END AS score FROM (
     SELECT study, sample_id, signature, round(sum(part), 9) AS az FROM (
      SELECT study, sample_id, signature, grp, avg(weight * z) AS part FROM (
       SELECT study, sample_id, gene_id, (value - avg(value) OVER s) / stddev_samp(value) OVER s AS z FROM expr
       WINDOW s AS (PARTITION BY study, sample_id)) JOIN sets USING (study, gene_id) WHERE branch = 'ips' GROUP BY ALL)
     GROUP BY ALL)""",
)
cte(
    "set_weight",
    "sets",
    "SELECT study, signature, sub_signature, branch, max(weight) AS w FROM sets GROUP BY ALL",
)
cte(
    "pio_score",
    "gs_score set_weight",
    """SELECT study, sample_id, signature, sum(w * score) AS score FROM gs_score
    JOIN set_weight USING (study, signature, sub_signature) WHERE branch = 'pio' GROUP BY ALL""",
)
cte(
    "ipr_score",
    "gs_score set_weight",
    """SELECT study, sample_id, signature, avg(z) AS score FROM (SELECT study, sample_id, signature,
     (score - avg(score) OVER s) / stddev_samp(score) OVER s AS z FROM gs_score
     JOIN set_weight USING (study, signature, sub_signature) WHERE branch = 'ipres'
     WINDOW s AS (PARTITION BY study, signature, sub_signature)) GROUP BY ALL""",
)
cte(
    "pas_score",
    "ss_score set_weight",
    """SELECT study, sample_id, signature, avg(score) AS score FROM ss_score
    JOIN set_weight USING (study, signature, sub_signature) WHERE branch = 'passon' GROUP BY ALL""",
)
cte(
    "ov_score",
    "ss_score set_weight",
    """SELECT study, sample_id, signature, sum(w * score) AS score FROM ss_score
    JOIN set_weight USING (study, signature, sub_signature) WHERE branch = 'ipsov' GROUP BY ALL""",
)
cte(
    "scores",
    "gs_score ss_score set_weight mean_score cox_score ips_score pio_score ipr_score pas_score ov_score",
    """SELECT study, sample_id, signature, score FROM gs_score JOIN set_weight USING (study, signature, sub_signature) WHERE branch = 'gsva'
    UNION ALL SELECT study, sample_id, signature, score FROM ss_score JOIN set_weight USING (study, signature, sub_signature) WHERE branch = 'ssgsea'
    UNION ALL """
    + " UNION ALL ".join(
        f"SELECT study, sample_id, signature, score FROM {t}_score" for t in ("mean", "cox", "ips", "pio", "ipr", "pas", "ov")
    ),
)
cte(
    "assembled",
    "scores signature gated",
    """SELECT g.study, g.sample_id, n.signature, s.score FROM gated g CROSS JOIN (SELECT DISTINCT signature FROM signature) n
    LEFT JOIN scores s ON s.study = g.study AND s.sample_id = g.sample_id AND s.signature = n.signature""",
)
cte(
    "complete",
    "assembled",
    """SELECT * FROM assembled WHERE (study, signature) IN (
    SELECT (study, signature) FROM assembled GROUP BY study, signature HAVING count(*) = count(score))""",
)
cte("chosen", "complete", "SELECT * FROM complete WHERE signature <> 'S4'")

# ---- mean score slice: light inputs for the feature operators -------------------------

cte("light", "mean_score cox_score ips_score",
    " UNION ALL ".join(f"SELECT study, sample_id, signature, score FROM {t}_score" for t in ("mean", "cox", "ips")))

# ---- vec ---------------------------------------------------------------------------------

cte(
    "vec",
    "",
    """SELECT 'V' || CAST(vec_id % 5 AS VARCHAR) AS study, CAST(vec_id AS VARCHAR) AS sample_id, CAST(label % 2 AS INTEGER) AS label,
    embedding AS v FROM embeddings""",
)
cte(
    "vexpr",
    "vec",
    """SELECT study, sample_id, label, 'd' || CASE WHEN i <= 10 THEN '0' ELSE '' END || CAST(i - 1 AS VARCHAR) AS gene_id, CAST(v[i] AS DOUBLE) AS value
    FROM vec, unnest(range(1, 65)) AS t(i)""",
)
cte(
    "vgene",
    "vexpr",
    """SELECT study, gene_id, CAST(substr(gene_id, 2) AS INTEGER) AS t, round(avg(value), 6) AS cut, CAST(count(*) AS DOUBLE) AS n,
    round(stddev_samp(value), 6) AS sd, round(avg(CAST(label AS DOUBLE)) - 0.5::DOUBLE, 6) AS rate FROM vexpr GROUP BY ALL""",
)
cte(
    "stump",
    "vgene",
    """SELECT a.study AS model_id, a.t AS tree_id, u.* FROM vgene a JOIN vgene b ON a.study = b.study AND b.t = (a.t + 1) % (SELECT count(DISTINCT t) FROM vgene),
    LATERAL (VALUES
     (0, a.gene_id, a.cut, 1, 2, NULL::DOUBLE, a.sd, a.n),
     (1, NULL, NULL, NULL, NULL, round(a.rate * 0.1::DOUBLE - a.sd * 0.05::DOUBLE, 6), NULL, a.n * 0.5::DOUBLE),
     (2, b.gene_id, b.cut, 5, 6, NULL, b.sd, a.n * 0.5::DOUBLE),
     (5, NULL, NULL, NULL, NULL, round(a.sd * 0.02::DOUBLE, 6), NULL, a.n * 0.25::DOUBLE),
     (6, NULL, NULL, NULL, NULL, round(a.rate * 0.1::DOUBLE + a.sd * 0.05::DOUBLE, 6), NULL, a.n * 0.25::DOUBLE)
    ) u(node_id, feature, threshold, "left", "right", leaf_value, gain, cover)""",
)
cte(
    "stump_margin",
    "stump vexpr",
    # cells of a sample against both splits of each tree
    """SELECT a.study, a.sample_id, r.model_id, sum(CASE WHEN a.value < r.threshold THEN l1.leaf_value
      WHEN b.value < s.threshold THEN l5.leaf_value ELSE l6.leaf_value END) AS margin
    FROM stump r JOIN stump s ON s.model_id = r.model_id AND s.tree_id = r.tree_id AND s.node_id = 2
    JOIN stump l1 ON l1.model_id = r.model_id AND l1.tree_id = r.tree_id AND l1.node_id = 1
    JOIN stump l5 ON l5.model_id = r.model_id AND l5.tree_id = r.tree_id AND l5.node_id = 5
    JOIN stump l6 ON l6.model_id = r.model_id AND l6.tree_id = r.tree_id AND l6.node_id = 6
    JOIN vexpr a ON a.gene_id = r.feature JOIN vexpr b ON b.study = a.study AND b.sample_id = a.sample_id AND b.gene_id = s.feature
    WHERE r.node_id = 0 GROUP BY ALL""",
)

# ---- doc -----------------------------------------------------------------------------------

cte(
    "doc",
    "",
    """SELECT lang AS study, CAST(doc_id AS VARCHAR) AS sample_id, CAST(1 - quality AS INTEGER) AS label, m.model_id,
    CASE m.model_id WHEN 'm1' THEN round(ln(n_chars + 1.0::DOUBLE), 9) ELSE CAST(length(text) % 97 AS DOUBLE) END AS score
    FROM documents JOIN labels USING (doc_id) CROSS JOIN (VALUES ('m1'), ('m2')) m(model_id)""",
)


def counts_text(source: str, keys: str = "study, model_id") -> str:
    return f"""SELECT {keys}, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
    FROM {source} WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY ALL"""


def ranked_text(source: str, keys: str = "study, model_id") -> str:
    total = f"(PARTITION BY {keys})"
    run = f"(PARTITION BY {keys} ORDER BY score ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT *, CAST(sum(pos) OVER {run} - pos AS BIGINT) AS bp, CAST(sum(neg) OVER {run} - neg AS BIGINT) AS bn,
    CAST(sum(pos) OVER {total} AS BIGINT) AS p, CAST(sum(neg) OVER {total} AS BIGINT) AS n,
    lag(score) OVER (PARTITION BY {keys} ORDER BY score) AS prev FROM {source}"""


def auc_text(source: str, keys: str = "study, model_id") -> str:
    """From the definition: share of (case, control) pairs in the right order."""
    join = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    listed = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {listed}, sum(CASE WHEN a.score > b.score THEN a.pos * b.neg WHEN a.score = b.score THEN a.pos * b.neg * 0.5::DOUBLE
    ELSE 0 END) / nullif(sum(CAST(a.pos * b.neg AS DOUBLE)), 0) AS auc FROM {source} a JOIN {source} b ON {join} GROUP BY ALL"""


cte("counts", "doc", counts_text("doc"))
cte("ranked", "counts", ranked_text("counts"))
cte("aucs", "counts", auc_text("counts"))
