"""SQL twin of every query, written from the tables rather than from the Spark plans.

Scores come from relational joins over long term tables; what the Spark side must read out
of rendered mail text is taken here from the columns the text was rendered from.
"""

from __future__ import annotations

import re

from peneira.standin.views import AS_OF, FIRST_WORDS, SECOND_WORDS

ACCENTED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"


def _term(x: str) -> str:
    folded = f"regexp_replace(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9+#.]+', ' ', 'g')"
    return f"trim(regexp_replace({folded}, '\\.+( |$)', ' ', 'g'))"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def _word(words: tuple[str, ...], i: str) -> str:
    return f"list_extract([{', '.join(repr(w) for w in words)}], CAST(({i}) % 8 AS INT) + 1)"


def _a(i: str) -> str:
    return _word(FIRST_WORDS, i)


def _b(i: str) -> str:
    return _word(SECOND_WORDS, i)


_CLIP = "CAST(round(greatest(least(raw, 100.0), 0.0)) AS INT)"
_DIMS = ("role", "technology", "seniority", "modality", "location")
_WEIGHT = {"role": 25.0, "technology": 35.0, "seniority": 15.0, "modality": 10.0, "location": 15.0}
_ANY = ("role", "seniority", "modality", "location")


def _share(d: str) -> str:
    met = f"CASE WHEN m_{d} > 0 THEN 1.0 ELSE 0.0 END" if d in _ANY else f"CAST(m_{d} AS DOUBLE) / n_{d}"
    return f"CASE WHEN n_{d} > 0 THEN CAST({met} AS DOUBLE) END AS {d}_share"


_EARNED = " + ".join(f"CAST({_WEIGHT[d]} AS DOUBLE) * coalesce({d}_share, 0)" for d in _DIMS)
_TOTAL = " + ".join(f"CASE WHEN n_{d} > 0 THEN {_WEIGHT[d]} ELSE 0 END" for d in _DIMS)



def _scored(pairs: str) -> str:
    counts = ", ".join(f"count_if(coalesce(dimension, '') = '{d}') AS m_{d}" for d in (*_DIMS, "required"))
    wishes = ", ".join(f"coalesce(n_{d}, 0) AS n_{d}" for d in (*_DIMS, "required"))
    return f"""SELECT *, CASE WHEN score >= 80 THEN 'Aplicar' WHEN score >= 50 THEN 'Avaliar' ELSE 'Ignorar' END AS classification FROM (
        SELECT *, {_CLIP} AS score FROM (
        SELECT *, CASE WHEN total_weight > 0 THEN 100.0 * ({_EARNED}) / total_weight ELSE 0.0 END
            + 20.0 * coalesce(required_share, 0) - 25.0 * unwanted_hits AS raw FROM (
        SELECT profile_id, job_id, unwanted_hits, n_required, n_technology, m_required, m_technology, n_role, n_seniority, n_modality, n_location,
            CAST({_TOTAL} AS DOUBLE) AS total_weight, {', '.join(_share(d) for d in (*_DIMS, 'required'))} FROM (
        SELECT * EXCLUDE ({', '.join(f"n_{d}" for d in (*_DIMS, 'required'))}), {wishes} FROM (
        SELECT profile_id, job_id, count_if(coalesce(dimension, '') = 'unwanted') AS unwanted_hits, {counts}
        FROM {pairs} GROUP BY profile_id, job_id) LEFT JOIN N USING (profile_id)))))"""


CTES: dict[str, str] = {
    "S": """SELECT CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS source_id,
        'Fonte ' || source AS name, source AS label,
        CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 2 = 0 THEN 'active' ELSE 'inactive' END AS status,
        CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' ELSE 'generic' END AS parser
        FROM (SELECT DISTINCT source FROM documents)""",
    "J": f"""SELECT p_partkey AS k, 'j' || p_partkey AS job_id, 'm' || (p_partkey // 3) AS message_id,
        CAST(p_partkey % 3 + 1 AS INT) AS block_no, (p_partkey // 3) % 20 AS source_id,
        p_name AS title, CASE WHEN p_size <> 13 THEN p_brand END AS company, n_name AS location, r_name AS region,
        CASE WHEN p_size <> 19 THEN 'HTTP://Jobs.Example.com/' || replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-')
            || '/' || p_type || '/?utm_source=src' || (p_partkey % 20) || '#top' END AS url,
        CASE WHEN p_size <> 19 THEN 'https://jobs.example.com/' || replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-')
            || '/' || p_type END AS canonical_url,
        CASE WHEN p_size <> 17 THEN CAST(o_orderdate AS DATE) END AS posted_at,
        CASE p_type WHEN 'ECONOMY' THEN 'Júnior' WHEN 'STANDARD' THEN 'Pleno' WHEN 'MEDIUM' THEN 'Sênior' WHEN 'LARGE' THEN 'Lead' END AS seniority,
        p_type = 'SMALL' AS is_trainee,
        CASE p_size % 4 WHEN 0 THEN 'Remoto' WHEN 1 THEN 'Híbrido' WHEN 2 THEN 'Presencial' END AS modality,
        CASE p_partkey % 3 WHEN 0 THEN 'CLT' WHEN 1 THEN 'PJ' ELSE CASE WHEN p_type = 'SMALL' THEN 'Estágio' END END AS contract,
        'Buscamos ' || p_name
            || coalesce(' ' || CASE p_type WHEN 'ECONOMY' THEN 'Júnior' WHEN 'STANDARD' THEN 'Pleno' WHEN 'MEDIUM' THEN 'Sênior'
               WHEN 'LARGE' THEN 'Lead' WHEN 'SMALL' THEN 'Estágio' END, '') || '.'
            || coalesce(' Regime ' || CASE p_size % 4 WHEN 0 THEN 'Remoto' WHEN 1 THEN 'Híbrido' WHEN 2 THEN 'Presencial' END || '.', '')
            || coalesce(' Contrato ' || CASE p_partkey % 3 WHEN 0 THEN 'CLT' WHEN 1 THEN 'PJ' END || '.', '') AS description
        FROM part JOIN orders ON o_orderkey = p_partkey JOIN nation ON n_nationkey = p_partkey % 25
        JOIN region ON r_regionkey = n_regionkey""",
    "P": f"""SELECT c_custkey AS profile_id, c_name AS full_name, 'perfil' || c_custkey || '@example.com' AS email,
        CASE WHEN c_custkey % 5 = 0 THEN 'pessoa candidata' ELSE {_a('c_custkey')} || ' ' || {_b('c_custkey // 8')} END AS current_role,
        n_name AS location, CASE c_custkey % 3 WHEN 1 THEN 'pt' WHEN 2 THEN 'en' END AS material_lang,
        CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'Atua com ' || lower(c_mktsegment) END AS summary,
        CAST(1 + c_custkey % 3 AS INT) AS version,
        CASE WHEN c_custkey % 5 = 0 THEN [] WHEN c_custkey % 3 = 0 THEN
            [{_a('c_custkey')} || ' ' || {_b('c_custkey // 8')}, {_a('c_custkey + 3')} || ' ' || {_b('c_custkey // 8 + 5')}]
            ELSE [{_a('c_custkey')} || ' ' || {_b('c_custkey // 8')}] END AS roles,
        CASE c_mktsegment WHEN 'BUILDING' THEN ['Pleno', 'Sênior'] WHEN 'AUTOMOBILE' THEN ['Júnior']
            WHEN 'MACHINERY' THEN ['Sênior', 'Lead'] WHEN 'HOUSEHOLD' THEN ['Pleno'] ELSE [] END AS seniority,
        CASE WHEN c_custkey % 7 = 0 THEN [] ELSE [{_a('c_custkey // 2')}, {_b('c_custkey // 16')}, {_b('c_custkey // 16 + 3')}] END AS technologies,
        CASE c_custkey % 4 WHEN 0 THEN ['Remoto'] WHEN 1 THEN ['Remoto', 'Híbrido'] WHEN 2 THEN ['Presencial'] ELSE [] END AS modalities,
        CASE c_custkey % 6 WHEN 0 THEN [] WHEN 1 THEN [r_name] WHEN 2 THEN [n_name, 'Remoto global'] ELSE [n_name] END AS locations,
        CASE c_custkey % 4 WHEN 1 THEN [{_b('c_custkey // 4')}] WHEN 2 THEN [{_a('c_custkey // 4')}, 'Remoto'] ELSE [] END AS required,
        CASE c_custkey % 3 WHEN 0 THEN [{_a('c_custkey + 5')}] WHEN 1 THEN ['Estágio'] ELSE [] END AS penalize,
        CASE c_custkey % 3 WHEN 1 THEN [{_b('c_custkey + 6')}] ELSE [] END AS discard,
        CASE WHEN c_custkey % 5 = 2 THEN ['Brand#' || (c_custkey % 25 + 1)] ELSE [] END AS avoid_companies,
        CASE WHEN c_custkey % 11 = 0 THEN [{_b('c_custkey // 11')}] ELSE [] END AS avoid_areas,
        CASE c_custkey % 6 WHEN 3 THEN ['PJ'] WHEN 4 THEN ['CLT', 'PJ'] ELSE [] END AS contract_types,
        CAST(60 + 5 * (c_custkey % 5) AS INT) AS min_score,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(365 * (1 + c_custkey % 6) AS INT) END AS max_age_days
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "T": "SELECT profile_id, dimension, " + _term("term") + """ AS term_norm, min(term) AS term, min(weight) AS weight, min(action) AS action FROM (
        SELECT profile_id, 'role' AS dimension, unnest(roles) AS term, 25.0 AS weight, 'boost' AS action FROM P
        UNION ALL SELECT profile_id, 'technology', unnest(technologies), 35.0, 'boost' FROM P
        UNION ALL SELECT profile_id, 'seniority', unnest(seniority), 15.0, 'boost' FROM P
        UNION ALL SELECT profile_id, 'modality', unnest(modalities), 10.0, 'boost' FROM P
        UNION ALL SELECT profile_id, 'location', unnest(locations), 15.0, 'boost' FROM P
        UNION ALL SELECT profile_id, 'required', unnest(required), 20.0, 'boost' FROM P
        UNION ALL SELECT profile_id, 'unwanted', unnest(penalize), -25.0, 'penalize' FROM P
        UNION ALL SELECT profile_id, 'unwanted', unnest(discard), -25.0, 'discard' FROM P
        UNION ALL SELECT profile_id, 'company', unnest(avoid_companies), 0.0, 'discard' FROM P
        UNION ALL SELECT profile_id, 'area', unnest(avoid_areas), 0.0, 'discard' FROM P
        UNION ALL SELECT profile_id, 'contract', unnest(contract_types), 0.0, 'discard' FROM P)
        GROUP BY profile_id, dimension, """ + _term("term"),
    # Terms the text of a posting holds that some profile names.
    "X": f"""SELECT DISTINCT job_id, term, in_title FROM (
        SELECT job_id, unnest([title, split_part(title, ' ', 1), split_part(title, ' ', 2)]) AS term, true AS in_title FROM J
        UNION ALL SELECT job_id, {_term('seniority')}, false FROM J
        UNION ALL SELECT job_id, 'estagio', false FROM J WHERE is_trainee
        UNION ALL SELECT job_id, {_term('modality')}, false FROM J
        UNION ALL SELECT job_id, {_term('contract')}, false FROM J)
        WHERE term IN (SELECT term_norm FROM T)""",
    "L": f"""SELECT job_id, unnest([{_term('location')}, {_term('region')}]
        || CASE WHEN modality = 'Remoto' THEN ['remoto global', 'remoto ' || {_term('location')}, 'remoto ' || {_term('region')}] ELSE [] END) AS term FROM J""",
    "F": f"""SELECT job_id, 'role' AS kind, term FROM X WHERE in_title
        UNION ALL SELECT DISTINCT job_id, 'term', term FROM (SELECT job_id, term FROM X UNION ALL SELECT job_id, term FROM L
            UNION ALL SELECT job_id, {_term('modality')} FROM J UNION ALL SELECT job_id, {_term('seniority')} FROM J)
        UNION ALL SELECT job_id, 'seniority', {_term('seniority')} FROM J WHERE seniority IS NOT NULL
        UNION ALL SELECT job_id, 'modality', {_term('modality')} FROM J WHERE modality IS NOT NULL
        UNION ALL SELECT job_id, 'location', term FROM L""",
    "N": "SELECT profile_id, " + ", ".join(
        f"count_if(dimension = '{d}') AS n_{d}" for d in (*_DIMS, "required")
    ) + " FROM T GROUP BY profile_id",
    "H": """SELECT profile_id, job_id, dimension, term_norm FROM T JOIN F ON F.term = T.term_norm
        AND F.kind = CASE dimension WHEN 'technology' THEN 'term' WHEN 'required' THEN 'term' WHEN 'unwanted' THEN 'term' ELSE dimension END
        WHERE dimension IN ('role', 'technology', 'seniority', 'modality', 'location', 'required')
        OR (dimension = 'unwanted' AND action = 'penalize')""",
    "D1": "SELECT job_id, first_value(job_id) OVER (PARTITION BY canonical_url ORDER BY posted_at NULLS LAST, job_id) AS kept FROM J WHERE canonical_url IS NOT NULL",
    "D2": "SELECT job_id, first_value(job_id) OVER (PARTITION BY company, title, location ORDER BY posted_at NULLS LAST, job_id) AS kept FROM J WHERE company IS NOT NULL",
    "A": _scored("H"),
    # Every pair worth a look, for all profiles alike.
    "G": """SELECT * FROM A WHERE score >= 50""",
    # A given list of pairs, with those that share no term.
    "PL": "SELECT DISTINCT o_custkey AS profile_id, 'j' || l_partkey AS job_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN J ON k = l_partkey",
    "AP": _scored("PL LEFT JOIN H USING (profile_id, job_id)"),
    "GU": "SELECT * FROM G UNION SELECT * FROM AP",
    "I": f"""SELECT profile_id, job_id, string_agg(reason, '; ' ORDER BY reason) AS reasons FROM (
        SELECT DISTINCT G.profile_id, G.job_id, 'term: ' || T.term_norm AS reason FROM GU AS G JOIN T ON T.profile_id = G.profile_id
            AND (dimension = 'area' OR (dimension = 'unwanted' AND action = 'discard')) JOIN F ON F.job_id = G.job_id AND F.kind = 'term' AND F.term = T.term_norm
        UNION ALL SELECT G.profile_id, G.job_id, 'company: ' || T.term_norm FROM GU AS G JOIN J USING (job_id) JOIN T ON T.profile_id = G.profile_id
            AND dimension = 'company' AND T.term_norm = {_term('company')}
        UNION ALL SELECT G.profile_id, G.job_id, 'contract: ' || {_term('contract')} FROM GU AS G JOIN J USING (job_id) JOIN P USING (profile_id)
            WHERE contract IS NOT NULL AND len(contract_types) > 0 AND NOT list_contains(contract_types, contract))
        GROUP BY profile_id, job_id""",
    "Q": f"""SELECT G.*, J.posted_at, J.modality, J.company, J.title, J.url, J.source_id, J.url IS NULL AS is_failed,
        nullif(coalesce(DG.head, J.job_id), J.job_id) AS dup_of,
        date_diff('day', coalesce(DG.newest, J.posted_at), DATE '{AS_OF}') AS age_days,
        coalesce(date_diff('day', coalesce(DG.newest, J.posted_at), DATE '{AS_OF}') > coalesce(P.max_age_days, 30), false) AS stale,
        I.reasons AS incompatible, P.material_lang, P.version, P.min_score
        FROM GU AS G JOIN J USING (job_id) JOIN P USING (profile_id) LEFT JOIN DG USING (job_id)
        LEFT JOIN I USING (profile_id, job_id)""",
    # Groups over duplicate links of either kind, with the posting each shows and its newest date.
    "DG": """SELECT job_id, first_value(job_id) OVER (PARTITION BY grp ORDER BY (url IS NULL), posted_at NULLS LAST, job_id) AS head,
        max(posted_at) OVER (PARTITION BY grp) AS newest FROM J JOIN (
        WITH RECURSIVE pair AS (SELECT job_id AS a, kept AS b FROM D1 WHERE kept <> job_id UNION SELECT job_id, kept FROM D2 WHERE kept <> job_id),
        tie AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
        got(id, other) AS (SELECT a, a FROM tie UNION SELECT r.id, l.b FROM got r JOIN tie l ON l.a = r.other)
        SELECT id AS job_id, min(other) AS grp FROM got GROUP BY id) USING (job_id)""",
    "ZU": """SELECT *, CASE WHEN is_failed THEN 'extraction_failed' WHEN dup_of IS NOT NULL THEN 'duplicate' WHEN stale THEN 'stale'
        WHEN incompatible IS NOT NULL THEN 'incompatible' ELSE 'active' END AS status FROM Q""",
    "Z": "SELECT * FROM ZU WHERE score >= 50",
    "ZP": "SELECT ZU.* FROM ZU JOIN PL USING (profile_id, job_id)",
    "B": """SELECT profile_id, job_id, company, title, posted_at, score, classification, S.name AS source, url, modality, min_score
        FROM Z LEFT JOIN S USING (source_id) WHERE Z.status = 'active'""",
    # Whether a pair is active does not depend on its score: all profiles with all postings.
    "NOFIT": f"""SELECT T.profile_id, F.job_id FROM T JOIN F ON F.kind = 'term' AND F.term = T.term_norm
            WHERE dimension = 'area' OR (dimension = 'unwanted' AND action = 'discard')
        UNION SELECT T.profile_id, J.job_id FROM T JOIN J ON T.dimension = 'company' AND T.term_norm = {_term('company')}
        UNION SELECT P.profile_id, J.job_id FROM P JOIN J ON contract IS NOT NULL AND len(contract_types) > 0 AND NOT list_contains(contract_types, contract)""",
    "VIS": f"""SELECT P.profile_id, J.job_id FROM P CROSS JOIN J LEFT JOIN DG ON DG.job_id = J.job_id ANTI JOIN NOFIT ON NOFIT.profile_id = P.profile_id AND NOFIT.job_id = J.job_id
        WHERE J.url IS NOT NULL AND coalesce(DG.head, J.job_id) = J.job_id
        AND NOT coalesce(date_diff('day', coalesce(DG.newest, J.posted_at), DATE '{AS_OF}') > coalesce(P.max_age_days, 30), false)""",
    "VN": """SELECT J.job_id, coalesce(z.n_scored, 0) AS n_scored, coalesce(z.n_aplicar, 0) AS n_aplicar, coalesce(z.n_avaliar, 0) AS n_avaliar,
        coalesce(v.n, 0) AS n_active, coalesce(v.n, 0) - coalesce(z.n_aplicar, 0) - coalesce(z.n_avaliar, 0) AS n_ignorar,
        (SELECT count(*) FROM P) - coalesce(v.n, 0) AS n_hidden FROM J LEFT JOIN (SELECT job_id, count(*) AS n FROM VIS GROUP BY job_id) v ON v.job_id = J.job_id
        LEFT JOIN (SELECT job_id, count(*) AS n_scored, count_if(status = 'active' AND classification = 'Aplicar') AS n_aplicar,
            count_if(status = 'active' AND classification = 'Avaliar') AS n_avaliar FROM Z GROUP BY job_id) z ON z.job_id = J.job_id""",
    "STR": """SELECT profile_id, job_id, string_agg(dimension || ': ' || term_norm, '; ' ORDER BY dimension || ': ' || term_norm) AS strengths
        FROM H WHERE dimension <> 'unwanted' GROUP BY profile_id, job_id""",
    "GAP": """SELECT G.profile_id, G.job_id, string_agg(T.dimension || ': ' || T.term_norm, '; ' ORDER BY T.dimension || ': ' || T.term_norm) AS gaps
        FROM GU AS G JOIN T ON T.profile_id = G.profile_id AND (dimension IN ('technology', 'required') OR (dimension = 'role' AND role_share = 0)
            OR (dimension = 'seniority' AND seniority_share = 0) OR (dimension = 'modality' AND modality_share = 0) OR (dimension = 'location' AND location_share = 0))
        LEFT JOIN H ON H.profile_id = G.profile_id AND H.job_id = G.job_id AND H.dimension = T.dimension AND H.term_norm = T.term_norm
        WHERE H.job_id IS NULL GROUP BY G.profile_id, G.job_id""",
    "RSN": """SELECT profile_id, job_id, classification || ' (' || score || '): ' || coalesce(nullif(concat_ws('; ',
        CASE WHEN n_role > 0 THEN CASE WHEN role_share > 0 THEN 'cargo compatível' ELSE 'cargo não compatível' END END,
        CASE WHEN n_technology > 0 THEN 'tecnologias ' || m_technology || '/' || n_technology END,
        CASE WHEN n_seniority > 0 THEN CASE WHEN seniority_share > 0 THEN 'senioridade compatível' ELSE 'senioridade não compatível' END END,
        CASE WHEN n_modality > 0 THEN CASE WHEN modality_share > 0 THEN 'modalidade compatível' ELSE 'modalidade não compatível' END END,
        CASE WHEN n_location > 0 THEN CASE WHEN location_share > 0 THEN 'localização compatível' ELSE 'localização não compatível' END END,
        CASE WHEN n_required > 0 THEN 'termos obrigatórios ' || m_required || '/' || n_required END,
        CASE WHEN unwanted_hits > 0 THEN 'termos indesejados ' || unwanted_hits END), ''), 'sem preferências') || '.' AS reason FROM GU""",
    "E": f"""SELECT profile_id, kind, name, {_term('name')} AS name_norm, level, kind || ':' || {_term('name')} AS fact_id,
        'Uso de ' || name || ' em projetos reais' AS evidence FROM (
        SELECT c_custkey AS profile_id, 'skill' AS kind, {_a('c_custkey // 2')} AS name, 'Avançado' AS level FROM customer
        UNION ALL SELECT c_custkey, 'skill', {_b('c_custkey // 16')}, 'Intermediário' FROM customer
        UNION ALL SELECT c_custkey, 'experience', {_b('c_custkey // 16 + 3')}, 'Sênior' FROM customer WHERE c_custkey % 9 <> 0
        UNION ALL SELECT c_custkey, 'project', 'Projeto ' || lower(c_mktsegment), NULL FROM customer
        UNION ALL SELECT c_custkey, 'education', 'Graduação', NULL FROM customer WHERE c_custkey % 13 <> 0
        UNION ALL SELECT c_custkey, 'certification', 'Certificação ' || c_nationkey, NULL FROM customer
        UNION ALL SELECT c_custkey, 'language', 'Português', 'Nativo' FROM customer)""",
    "R": """SELECT Z.* FROM Z WHERE score >= 80 AND status = 'active' AND profile_id % 10 <> 0 AND profile_id % 9 <> 0 AND profile_id % 13 <> 0""",
    "K": """SELECT R.profile_id, R.job_id, E.fact_id, E.name, E.level, E.evidence,
        row_number() OVER (PARTITION BY R.profile_id, R.job_id ORDER BY E.fact_id) AS position
        FROM R JOIN E USING (profile_id) JOIN F ON F.job_id = R.job_id AND F.kind = 'term' AND F.term = E.name_norm""",
    "KL": """SELECT profile_id, job_id, string_agg('- ' || name || coalesce(' (' || level || ')', '') || ': ' || evidence, chr(10) ORDER BY position) AS facts,
        string_agg(fact_id, '; ' ORDER BY position) AS ids FROM K GROUP BY profile_id, job_id""",
    "C": """SELECT R.profile_id, R.job_id, coalesce(R.material_lang, 'pt') AS lang, P.full_name, P.current_role, coalesce(P.summary, '') AS summary,
        R.title, coalesce(R.company, '') AS company, J.location, R.score, R.classification, RSN.reason, KL.facts, KL.ids
        FROM R JOIN P USING (profile_id) JOIN J USING (job_id) JOIN RSN USING (profile_id, job_id) LEFT JOIN KL USING (profile_id, job_id)""",
    "DR": """SELECT profile_id, job_id, 'cv' AS kind, lang, full_name || chr(10) || current_role || chr(10) || summary || chr(10)
            || CASE lang WHEN 'en' THEN 'Relevant to ' ELSE 'Relevante para ' END || title || ':' || chr(10) || facts AS body FROM C WHERE facts IS NOT NULL
        UNION ALL SELECT profile_id, job_id, 'letter', lang, CASE lang WHEN 'en' THEN 'Dear ' || company || ' team,' || chr(10) || 'I am interested in the ' || title
            || ' position. My registered facts:' ELSE 'Prezada equipe ' || company || ',' || chr(10) || 'Tenho interesse na vaga ' || title || '. Meus fatos registrados:' END
            || chr(10) || facts || chr(10) || full_name FROM C WHERE facts IS NOT NULL
        UNION ALL SELECT profile_id, job_id, 'summary', lang, title || ' - ' || company || ' - ' || location || chr(10) || 'Score ' || score || ' (' || classification || ')'
            || chr(10) || reason FROM C
        UNION ALL SELECT profile_id, job_id, 'highlights', lang, CASE lang WHEN 'en' THEN 'Highlight in your application:' ELSE 'Destaque na candidatura:' END
            || chr(10) || facts FROM C WHERE facts IS NOT NULL""",
    # Mail rows: rendered mails, and documents read by the generic layout.
    "ML": """SELECT message_id, 'src' || source_id AS label, CAST(count(*) AS BIGINT) AS n_jobs,
        count_if(company IS NULL OR url IS NULL) AS n_incomplete FROM J GROUP BY message_id, source_id""",
    "DC": """SELECT 'd' || doc_id AS message_id, source AS label, doc_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 3 AS layout, text FROM documents""",
    # A document is a posting only where its layout finds a title line or a link.
    "DB": r"""SELECT message_id, label, layout, regexp_replace(block, '^[ \t\n]+|[ \t\n]+$', '', 'g') AS block FROM (
        SELECT message_id, label, layout, unnest(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n-{5,}[ \t]*\n')) AS block FROM DC)
        WHERE trim(block) <> ''""",
    "DJ": r"""SELECT message_id, label, CAST(count(*) AS BIGINT) AS n_jobs, count(*) AS n_incomplete FROM (
        SELECT message_id, label,
            CASE layout WHEN 2 THEN regexp_extract(block, '(?mi)^(?:cargo|vaga|title|job): *([^\n]*)', 1) ELSE regexp_extract(block, '^([^\n]*)', 1) END AS title,
            CASE layout WHEN 2 THEN regexp_extract(block, '(?i)(https?://[^\s<>"]+)', 1) WHEN 1 THEN regexp_extract(block, '(?mi)^(https?://\S+)$', 1)
                ELSE regexp_extract(block, '(?m)^(?:Ver vaga|View job): *(\S+)', 1) END AS url FROM DB)
        WHERE trim(title) <> '' OR trim(url) <> '' GROUP BY message_id, label""",
    "MS": """SELECT m.message_id, m.label, coalesce(j.n_jobs, 0) AS n_jobs,
        CASE WHEN j.n_jobs IS NULL THEN 'failed' WHEN j.n_incomplete > 0 THEN 'incomplete' ELSE 'parsed' END AS status,
        CASE WHEN j.n_jobs IS NULL THEN CASE WHEN m.blank THEN 'empty_message' ELSE 'no_posting_found' END END AS error, m.received_at
        FROM (SELECT message_id, label, false AS blank, TIMESTAMP '2001-09-01 08:00:00' AS received_at FROM ML
              UNION ALL SELECT message_id, label, trim(coalesce(text, '')) = '', to_timestamp(1704067200 + doc_id * 60)::TIMESTAMP FROM DC) m
        LEFT JOIN (SELECT * FROM ML UNION ALL SELECT * FROM DJ) j ON j.message_id = m.message_id""",
}
_NEEDS = {name: [c for c in CTES if c != name and re.search(rf"(?<![\w.']){c}\b(?!')", body)] for name, body in CTES.items()}
ORACLE: dict[str, str] = {}


def _order(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _order(_NEEDS[n], seen)
            if n not in seen:
                seen.append(n)
    return seen


def oracle(name: str, body: str) -> None:
    """Register ``body`` with the views it names put in front of it."""
    names = [c for c in CTES if re.search(rf"(?:FROM|JOIN|from|join) {c}\b", body)]
    views = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in _order(names, []))
    extra = body.lstrip()
    if extra.upper().startswith("WITH RECURSIVE "):
        ORACLE[name] = f"WITH RECURSIVE {views}, {extra[15:]}" if views else extra
    else:
        ORACLE[name] = f"WITH {views} {extra}" if views else extra


oracle("src1_active_sources", "SELECT source_id, name, label, parser FROM S WHERE status = 'active'")
oracle("src2_save_sources", """SELECT label, arg_max(status, updated_at) AS status, max(updated_at) AS updated_at FROM (
    SELECT label, status, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM S
    UNION ALL SELECT source, CASE WHEN lang = 'en' THEN 'active' ELSE 'inactive' END, to_timestamp(1704067200 + max(doc_id) * 60)::TIMESTAMP
    FROM documents GROUP BY source, lang) GROUP BY label""")
oracle("src3_check_labels", """SELECT w.label, c.label_path AS found_path, CASE WHEN c.label_path IS NOT NULL THEN 'id-' || w.label END AS label_id,
    CASE WHEN c.label_path IS NULL THEN 'missing' ELSE 'found' END AS label_status, 'Vagas/' || split_part(w.label, '/', 2) AS parent_label, CAST(3 AS INT) AS depth
    FROM (SELECT DISTINCT 'Vagas/' || source || '/' || lang AS label FROM documents) w
    LEFT JOIN (SELECT DISTINCT 'Vagas/src' || (page_id % 20) || '/' || regexp_extract(html, 'html lang="([a-z]+)"', 1) AS label_path FROM pages) c ON c.label_path = w.label""".replace(" c.label_path AS found_path,", ""))
oracle("src4_read_messages", """SELECT 'd' || doc_id AS message_id, source AS label, to_timestamp(1704067200 + doc_id * 60)::TIMESTAMP AS received_at, md5(text) AS text_md5
    FROM documents WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 2 = 0""")
_EVENTS = """SELECT user_id || ':' || event_type || ':' || CAST(floor(value) AS BIGINT) AS message_id, event_type AS label, ts AS received_at, event_id AS arrival_no FROM events"""
oracle("src5_drop_seen", f"""SELECT message_id, label, received_at, arrival_no FROM ({_EVENTS}) e WHERE received_at >= TIMESTAMP '2024-01-15'
    AND message_id NOT IN (SELECT message_id FROM ({_EVENTS}) o WHERE received_at < TIMESTAMP '2024-01-15')
    QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY received_at, label, arrival_no) = 1""")
ORACLE["src5_known_ids"] = ORACLE["src5_drop_seen"]
oracle("src9_sync_ledger", f"""SELECT l.label, CASE WHEN length(l.label) % 2 = 0 THEN 'active' ELSE 'inactive' END AS status,
    CASE WHEN length(l.label) % 2 = 0 THEN TIMESTAMP '2024-02-02 00:00:00' END AS last_sync_at, CAST(t.n AS BIGINT) AS n_taken, t.newest_at
    FROM (SELECT DISTINCT label FROM ({_EVENTS}) e WHERE received_at < TIMESTAMP '2024-01-15') l LEFT JOIN (
    SELECT label, count(*) AS n, max(received_at) AS newest_at FROM (SELECT * FROM ({_EVENTS}) e WHERE length(label) % 2 = 0
        QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY received_at, label, arrival_no) = 1) GROUP BY label) t ON t.label = l.label""")
oracle("src6_append_raw", "SELECT 'd' || doc_id AS message_id, source AS label, md5(text) AS text_md5 FROM documents")
oracle("src7_sync_stream", f"""SELECT message_id, label, received_at, arrival_no FROM ({_EVENTS}) e
    QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY received_at, label, arrival_no) = 1""")
oracle("src7_sync_active_labels", f"""SELECT message_id, label, received_at, arrival_no FROM ({_EVENTS}) e WHERE length(label) % 2 = 0
    QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY received_at, label, arrival_no) = 1""")
oracle("src8_message_status", "SELECT message_id, label, n_jobs, status, error FROM MS")
oracle("src9_sync_summary", """SELECT S.label, S.status AS source_status, max(received_at) AS last_sync_at, count(message_id) AS n_messages,
    CAST(0 AS BIGINT) AS n_new, count_if(MS.status = 'failed') AS n_failed FROM S LEFT JOIN MS ON MS.label = S.label GROUP BY S.label, S.status""")
oracle("src10_write_table", """SELECT profile_id, job_id, score + CASE WHEN max(score) OVER (PARTITION BY profile_id) >= 80 THEN 1000 ELSE 0 END AS score, classification FROM G""")

oracle("src10_store_jobs", """SELECT job_id, message_id, title, company, posted_at,
    CAST(CASE WHEN posted_at >= DATE '2001-01-01' THEN 2 ELSE 1 END AS INT) AS parser_version FROM J""")
oracle("src10_store_analyses", """SELECT AP.profile_id, AP.job_id, AP.score, AP.classification, reason,
    CAST(P.version + CASE WHEN AP.profile_id % 10 = 3 THEN 1 ELSE 0 END AS INT) AS profile_version
    FROM AP JOIN RSN ON RSN.profile_id = AP.profile_id AND RSN.job_id = AP.job_id JOIN P ON P.profile_id = AP.profile_id""")
oracle("src10_store_materials", """SELECT profile_id, job_id, kind, lang, md5(CASE WHEN lang = 'pt' THEN 'v2 ' || body ELSE body END) AS body_md5 FROM DR""")

oracle("prf1_load_profiles", """SELECT profile_id, full_name, email, current_role, location, material_lang, summary, version,
    array_to_string(list_sort(roles), '; ') AS roles, array_to_string(list_sort(technologies), '; ') AS technologies, min_score, coalesce(max_age_days, 30) AS max_age_days FROM P""")
oracle("prf2_save_profiles", """SELECT profile_id, CASE WHEN c_acctbal < 0 THEN 'Resumo revisto' ELSE summary END AS summary,
    CAST(version + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INT) AS version FROM P JOIN customer ON c_custkey = profile_id""")
oracle("prf3_profile_terms", "SELECT profile_id, dimension, term, term_norm, CAST(weight AS DOUBLE) AS weight, action FROM T")
oracle("prf4_missing_cv_sections", """SELECT * FROM (SELECT profile_id, concat_ws('; ', CASE WHEN profile_id % 10 = 0 THEN 'summary' END,
    CASE WHEN profile_id % 9 = 0 THEN 'experience' END, CASE WHEN profile_id % 13 = 0 THEN 'education' END) AS missing_sections FROM P) WHERE missing_sections <> ''""")

oracle("ext1_route_parser", """SELECT message_id, m.label, coalesce(S.parser, 'generic') AS parser FROM (SELECT message_id, label FROM ML UNION ALL SELECT message_id, label FROM DC) m
    LEFT JOIN S ON S.label = m.label AND S.status = 'active'""")
_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
    '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
    '(?i)<br[^>]*>|</(?:p|div|tr|li|ul|h[1-6]|article|nav|footer|title)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"""
_DECODED = "{x}"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("#39", "''"), ("amp", "&")):
    _DECODED = f"replace({_DECODED}, '&{_name};', '{_char}')"


def _text(x: str) -> str:
    decoded = _DECODED.format(x=_STRIPPED.format(x=x))
    lines = rf"trim(regexp_replace(regexp_replace({decoded}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'))"
    return rf"trim(regexp_replace({lines}, '^\n|\n$', '', 'g'))"


oracle("ext2_html_to_text", f"SELECT page_id, {_text('html')} AS text FROM pages")
oracle("ext3_split_blocks", r"""SELECT 'p' || page_id AS message_id, CAST(n AS INT) AS block_no, regexp_replace(parts[n + 1], '(?is)</p>.*$', '') AS block
    FROM (SELECT page_id, parts, unnest(range(1, len(parts))) AS n FROM (SELECT page_id, string_split_regex(html, '(?i)<p(?:\s[^>]*)?>') AS parts FROM pages))""")


def _inner(pattern: str) -> str:
    return rf"nullif(trim(regexp_replace({_text(f'regexp_extract(html, {pattern!r}, 1)')}, '[ \t\r\n\f]+', ' ', 'g')), '')"


oracle("ext4_extract_generic", f"""SELECT 'p' || page_id AS message_id, {_inner('(?is)<h1[^>]*>(.*?)</h1>')} AS title,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS company, regexp_extract(html, '(?i)href="([^"]+)"', 1) AS first_link,
    {_inner('(?is)<p(?:[ ][^>]*)?>(.*?)(?:</p>|<p[ >])')} AS description FROM pages""")
for _n, _parser, _key in ((0, "linkedin", "ext5_extract_linkedin"), (1, "indeed", "ext6_extract_indeed"), (2, "generic", "ext4_extract_generic_mails")):
    oracle(_key, f"""SELECT message_id, block_no, title, company, location, url, description, coalesce(posted_at, DATE '{AS_OF}') AS posted_at
        FROM J WHERE source_id % 3 = {_n}""")
oracle("ext7_parse_date", f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN DATE '{AS_OF}' ELSE CAST(o_orderdate AS DATE) END AS posted_at FROM orders")
oracle("ext8_canonical_url", r"""SELECT page_id, 'https://' || host || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url, host FROM (
    SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, list_sort([x FOR x IN string_split(regexp_extract(url, '\?([^#]*)', 1), '&')
    IF x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)=')]) AS params FROM pages)""")
oracle("ext9_norm", f"SELECT doc_id, {_norm('text')} AS text_norm FROM documents")
oracle("ext10_missing_fields", """SELECT job_id, concat_ws('; ', CASE WHEN company IS NULL THEN 'company' END, CASE WHEN url IS NULL THEN 'url' END,
    CASE WHEN posted_at IS NULL THEN 'posted_at' END) AS missing FROM J""")
oracle("ext11_extraction_failures", "SELECT message_id, label, error FROM MS WHERE status = 'failed'")
oracle("ext12_to_reprocess", "SELECT message_id, label FROM MS WHERE status IN ('failed', 'incomplete')")
oracle("ext13_tag_terms", """SELECT job_id, string_agg(DISTINCT term, '; ' ORDER BY term) AS terms,
    coalesce(string_agg(DISTINCT term, '; ' ORDER BY term) FILTER (WHERE in_title), '') AS title_terms,
    coalesce(string_agg(DISTINCT term, '; ' ORDER BY term) FILTER (WHERE term IN (SELECT term_norm FROM T WHERE dimension = 'technology')), '') AS technologies
    FROM X GROUP BY job_id""")
oracle("ext14_tag_modality", "SELECT job_id, modality FROM J")
oracle("ext15_tag_seniority", "SELECT job_id, seniority FROM J")
oracle("ext16_tag_location", "SELECT job_id, string_agg(term, '; ' ORDER BY term) AS location_keys FROM L GROUP BY job_id")
oracle("ext17_job_summary", r"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1) <> ''
    THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1) ELSE substr(text, 1, 200) END AS summary FROM documents""")

oracle("cln1_dup_by_link", "SELECT J.job_id, canonical_url, nullif(kept, J.job_id) AS dup_of FROM J LEFT JOIN D1 ON D1.job_id = J.job_id")
oracle("cln2_dup_by_content", "SELECT J.job_id, nullif(kept, J.job_id) AS dup_of FROM J LEFT JOIN D2 ON D2.job_id = J.job_id")
_WORDS = f"[x FOR x IN string_split({_term('text')}, ' ') IF x <> '']"
_NEAR = f"""sets AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN
        [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END)) AS s
        FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0),
    led AS MATERIALIZED (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS leader FROM sets),
    lone AS MATERIALIZED (SELECT doc_id, s, len(s) AS n FROM led WHERE doc_id = leader),
    sh AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS x FROM lone),
    met AS MATERIALIZED (SELECT a.doc_id AS id_a, b.doc_id AS id_b, a.n AS na, b.n AS nb, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    near AS MATERIALIZED (SELECT id_a, id_b, CAST(c AS DOUBLE) / (na + nb - c) AS jaccard FROM met WHERE CAST(c AS DOUBLE) / (na + nb - c) >= 0.8
        UNION ALL SELECT leader, doc_id, 1.0 FROM led WHERE doc_id <> leader)"""
oracle("cln3_near_dup_pairs", f"WITH {_NEAR} SELECT id_a, id_b, jaccard FROM near")
oracle("cln4_dup_groups", f"""WITH RECURSIVE {_NEAR}, edge AS MATERIALIZED (
    SELECT job_id AS a, kept AS b FROM D1 WHERE kept <> job_id UNION SELECT job_id, kept FROM D2 WHERE kept <> job_id
    UNION SELECT 'd' || id_a, 'd' || id_b FROM near),
    link AS MATERIALIZED (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
    reach(id, other) AS (SELECT a, a FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other)
    SELECT id, min(other) AS group_id FROM reach GROUP BY id""")
oracle("cln5_flag_stale", "SELECT profile_id, job_id, CAST(coalesce(age_days, -1) AS INT) AS age_days, stale FROM Z")
oracle("cln6_flag_incompatible", "SELECT profile_id, job_id, incompatible AS reasons FROM Z WHERE incompatible IS NOT NULL")
oracle("cln7_flag_failed", """SELECT job_id, concat_ws('; ', CASE WHEN company IS NULL THEN 'company' END, 'url',
    CASE WHEN posted_at IS NULL THEN 'posted_at' END) AS missing FROM J WHERE url IS NULL""")
oracle("cln8_resolve_status", """SELECT profile_id, job_id, status, concat_ws('; ', CASE WHEN is_failed THEN 'extraction_failed' END,
    CASE WHEN dup_of IS NOT NULL THEN 'duplicate' END, CASE WHEN stale THEN 'stale' END, CASE WHEN incompatible IS NOT NULL THEN 'incompatible' END) AS reasons FROM Z""")
oracle("cln9_latest_jobs", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
_LINE = "SELECT min('d' || doc_id) OVER (PARTITION BY text) AS group_id, 'd' || doc_id AS job_id, 'd' || doc_id AS message_id, to_timestamp(1704067200 + doc_id * 60)::TIMESTAMP AS received_at FROM documents"
oracle("cln10_job_lineage", _LINE)
oracle("cln10_lineage_summary", f"""SELECT group_id, min(received_at) AS first_seen, max(received_at) AS last_seen, count(DISTINCT job_id) AS n_jobs,
    count(DISTINCT message_id) AS n_messages FROM ({_LINE}) l GROUP BY group_id""")

oracle("scr1_candidate_pairs", """SELECT profile_id, count(*) AS n_pairs, min(job_id) AS first_job, max(job_id) AS last_job
    FROM G GROUP BY profile_id""")
oracle("scr1_class_counts", "SELECT job_id, n_scored, n_active, n_aplicar, n_avaliar, n_ignorar, n_hidden FROM VN")
for _n, _dim in enumerate((*_DIMS, "required"), start=2):
    oracle(f"scr{_n}_{_dim}_share", f"SELECT profile_id, job_id, {_dim}_share FROM AP")
oracle("scr8_unwanted_hits", "SELECT profile_id, job_id, unwanted_hits FROM AP")
oracle("scr9_total_score", "SELECT profile_id, job_id, score FROM AP")
_POINTS = " UNION ALL ".join(
    [f"SELECT profile_id, job_id, '{d}' AS dimension, 100.0 * (CAST({_WEIGHT[d]} AS DOUBLE) * {d}_share) / total_weight AS points FROM AP WHERE n_{d} > 0" for d in _DIMS]
    + ["SELECT profile_id, job_id, 'required', CAST(20.0 AS DOUBLE) * required_share FROM AP WHERE n_required > 0",
       "SELECT profile_id, job_id, 'unwanted', CAST(-25.0 AS DOUBLE) * unwanted_hits FROM AP WHERE unwanted_hits > 0"])
oracle("scr10_score_breakdown", f"""SELECT b.profile_id, b.job_id, b.dimension, b.points, coalesce(h.evidence, '') AS evidence FROM ({_POINTS}) b
    LEFT JOIN (SELECT profile_id, job_id, dimension, string_agg(term_norm, '; ' ORDER BY term_norm) AS evidence FROM H GROUP BY ALL) h
    ON h.profile_id = b.profile_id AND h.job_id = b.job_id AND h.dimension = b.dimension""")
oracle("scr11_strengths", "SELECT G.profile_id, G.job_id, coalesce(strengths, '') AS strengths FROM AP G LEFT JOIN STR ON STR.profile_id = G.profile_id AND STR.job_id = G.job_id")
oracle("scr12_gaps", "SELECT G.profile_id, G.job_id, coalesce(gaps, '') AS gaps FROM AP G LEFT JOIN GAP ON GAP.profile_id = G.profile_id AND GAP.job_id = G.job_id")
oracle("scr13_reason", "SELECT profile_id, job_id, reason FROM RSN JOIN PL USING (profile_id, job_id)")
oracle("scr14_classify", "SELECT profile_id, job_id, classification FROM AP")
oracle("scr15_rank_jobs", """SELECT profile_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, posted_at DESC NULLS LAST, job_id) AS INT) AS rank,
    job_id, posted_at, score, classification FROM Z WHERE status = 'active' QUALIFY rank <= 20""")
ORACLE["scr15_rank_stored"] = ORACLE["scr15_rank_jobs"]
# The same over postings read from mails: numbered by message and block, undated ones as of receipt.
_FROM_MAIL = f"""SELECT * REPLACE (message_id || '-' || block_no AS job_id, coalesce(posted_at, DATE '{AS_OF}') AS posted_at) FROM ({CTES['J']})"""
ORACLE["scr15_mail_to_ranked"] = ORACLE["scr15_rank_jobs"].replace(f"J AS MATERIALIZED ({CTES['J']})", f"J AS MATERIALIZED ({_FROM_MAIL})")
oracle("scr16_stale_pairs", "SELECT profile_id, version, job_id FROM ZP WHERE score < 70 OR score >= 90")

oracle("scr16_rescore", """SELECT G.profile_id, G.job_id, score, classification FROM G JOIN J ON J.job_id = G.job_id JOIN customer ON c_custkey = G.profile_id
    WHERE CAST(c_acctbal AS DECIMAL(12, 2)) < 0 OR posted_at >= DATE '2001-06-01'""")
_MAIN = "profile_id, job_id, company, title, posted_at, score, classification, source, url"
for _key, _where in (
    ("dsh1_job_list", "true"), ("dsh2_min_score", "score >= 85"),
    ("dsh3_technology", "job_id IN (SELECT job_id FROM X WHERE term IN ('ring', 'gizmo'))"),
    ("dsh4_modality", "modality IN ('Remoto', 'Híbrido')"), ("dsh5_company", "company IN ('Brand#7', 'Brand#11')"),
    ("dsh6_source", "source IN ('Fonte src4', 'Fonte src7')"), ("dsh7_class", "classification = 'Aplicar'"),
):
    oracle(_key, f"SELECT {_MAIN} FROM B WHERE score >= coalesce({'0' if _key == 'dsh2_min_score' else 'min_score'}, 0) AND {_where}" if _key != "dsh1_job_list" else f"SELECT {_MAIN} FROM B")
oracle("dsh7_class_ignored", f"""SELECT profile_id, job_id, company, title, posted_at, score, classification, S.name AS source, url
    FROM ZP LEFT JOIN S USING (source_id) WHERE ZP.status = 'active' AND classification = 'Ignorar'""")
oracle("dsh8_job_detail", r"""SELECT Z.profile_id, Z.job_id, Z.title, Z.company, J.location, S.name AS source, Z.url,
    CASE WHEN length(description) <= 40 THEN description WHEN regexp_extract(substr(description, 1, 40), '(?s)^(.*[.!?])', 1) <> ''
        THEN regexp_extract(substr(description, 1, 40), '(?s)^(.*[.!?])', 1) ELSE substr(description, 1, 40) END AS summary,
    Z.score, Z.classification, coalesce(strengths, '') AS strengths, coalesce(gaps, '') AS gaps, reason, k.draft_kinds
    FROM ZP Z JOIN J ON J.job_id = Z.job_id LEFT JOIN S ON S.source_id = Z.source_id
    LEFT JOIN STR ON STR.profile_id = Z.profile_id AND STR.job_id = Z.job_id LEFT JOIN GAP ON GAP.profile_id = Z.profile_id AND GAP.job_id = Z.job_id
    JOIN RSN ON RSN.profile_id = Z.profile_id AND RSN.job_id = Z.job_id
    LEFT JOIN (SELECT profile_id, job_id, string_agg(kind, '; ' ORDER BY kind) AS draft_kinds FROM DR GROUP BY profile_id, job_id) k
    ON k.profile_id = Z.profile_id AND k.job_id = Z.job_id""")
oracle("dsh9_facet_counts", " UNION ALL ".join(
    f"SELECT '{f}' AS facet, {f} AS value, count(*) AS n FROM B GROUP BY {f}" for f in ("source", "company", "modality", "classification")
) + """ UNION ALL SELECT 'technology', term, count(*) FROM (SELECT DISTINCT B.profile_id, B.job_id, X.term FROM B JOIN X ON X.job_id = B.job_id
    WHERE X.term IN (SELECT term_norm FROM T WHERE dimension = 'technology')) GROUP BY term""")

_ALL = "(SELECT VN.*, J.company, J.modality, S.name AS source FROM VN JOIN J ON J.job_id = VN.job_id LEFT JOIN S ON S.source_id = J.source_id) r"
oracle("dsh9_facets_all_classes", "SELECT facet, value, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    [f"SELECT '{f}' AS facet, {f} AS value, sum(n_active) AS n FROM {_ALL} GROUP BY {f}" for f in ("source", "company", "modality")]
    + [f"SELECT 'classification', '{c}', sum(n_{c.lower()}) FROM {_ALL}" for c in ("Aplicar", "Avaliar", "Ignorar")]
    + ["""SELECT 'technology', term, sum(n_active) FROM (SELECT DISTINCT job_id, term FROM X WHERE term IN (SELECT term_norm FROM T WHERE dimension = 'technology')) x
        JOIN VN USING (job_id) GROUP BY term"""]
) + ") WHERE n > 0")

oracle("mat1_eligible", "SELECT profile_id, job_id, score FROM Z WHERE score >= 80 AND status = 'active'")
oracle("mat2_ready", "SELECT profile_id, job_id FROM R")
oracle("mat3_match_evidence", "SELECT profile_id, job_id, fact_id, name, level FROM K")
for _key, _kind in (("mat4_tailored_cv", "cv"), ("mat5_cover_letter", "letter"), ("mat6_strategic_summary", "summary")):
    oracle(_key, f"SELECT profile_id, job_id, lang, body FROM DR WHERE kind = '{_kind}'")
oracle("mat7_highlights", "SELECT profile_id, job_id, CAST(position AS INT) AS position, fact_id FROM K WHERE position <= 1")
oracle("mat8_pick_lang", "SELECT profile_id, job_id, lang FROM C")
oracle("mat9_ungrounded", "SELECT profile_id, job_id, kind, 'skill:inventada' AS fact_id FROM DR WHERE lang = 'en'")
oracle("mat10_latest_materials", """SELECT profile_id, job_id, kind, md5(CASE WHEN lang = 'pt' THEN 'v2 ' || body ELSE body END) AS body_md5,
    CASE WHEN lang = 'pt' THEN TIMESTAMP '2001-10-01 00:00:00' ELSE TIMESTAMP '2001-09-01 00:00:00' END AS created_at FROM DR""")
oracle("ops1_failure_report", """SELECT label, status, error, CAST(grouping(label, status, error) AS BIGINT) AS level, count(*) AS n_messages
    FROM MS GROUP BY ROLLUP (label, status, error)""")
_FUNNEL = ("n_scored", "n_active", "n_aplicar", "n_avaliar", "n_ignorar", "n_hidden")
oracle("ops2_funnel", f"""SELECT coalesce(m.label, z.label) AS label, coalesce(m.n_collected, 0) AS n_collected, coalesce(m.n, 0) AS n_extracted,
    {', '.join(f'CAST(coalesce(z.{c}, 0) AS BIGINT) AS {c}' for c in _FUNNEL)}
    FROM (SELECT label, count(*) AS n_collected, CAST(sum(n_jobs) AS BIGINT) AS n FROM MS GROUP BY label) m
    FULL JOIN (SELECT 'src' || J.source_id AS label, {', '.join(f'sum({c}) AS {c}' for c in _FUNNEL)} FROM J JOIN VN ON VN.job_id = J.job_id GROUP BY J.source_id) z
    ON z.label = m.label""")

# The same with near-equal texts as links: documents stand for the texts of the postings of their number.
_NEAR_TEXTS = _NEAR.replace("FROM documents)", "FROM documents JOIN part ON p_partkey = doc_id)")
_NEAR_GROUPS = CTES["DG"].replace("UNION SELECT job_id, kept FROM D2 WHERE kept <> job_id),", "UNION SELECT job_id, kept FROM D2 WHERE kept <> job_id UNION SELECT 'j' || id_b, 'j' || id_a FROM near),")
oracle("cln8_status_near_texts", """SELECT profile_id, job_id, status, array_to_string(list_sort([r FOR r IN [CASE WHEN is_failed THEN 'extraction_failed' END,
    CASE WHEN dup_of IS NOT NULL THEN 'duplicate' END, CASE WHEN stale THEN 'stale' END, CASE WHEN incompatible IS NOT NULL THEN 'incompatible' END] IF r IS NOT NULL]), '; ') AS reasons FROM ZP""")
ORACLE["scr15_rank_near_texts"] = ORACLE["scr15_rank_jobs"]
for _key in ("cln8_status_near_texts", "scr15_rank_near_texts"):
    ORACLE[_key] = ORACLE[_key].replace(f"DG AS MATERIALIZED ({CTES['DG']})", f"{_NEAR_TEXTS}, DG AS MATERIALIZED ({_NEAR_GROUPS})")

# Batch by batch the same rows come out as at once.
for _key, _whole in (
    ("ext13_tag_stored", "ext13_tag_terms"), ("cln3_pairs_in_batches", "cln3_near_dup_pairs"),
    ("cln4_groups_in_batches", "cln4_dup_groups"), ("scr16_rescore_stored", "scr16_rescore"),
):
    ORACLE[_key] = ORACLE[_whole]
