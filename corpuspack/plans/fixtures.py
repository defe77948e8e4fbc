"""Derived views over the driver tables (``documents`` and ``events``) that give the
file-packing operators real volume: a ``files`` table with both comment styles and
docstrings, raw bytes with bad UTF-8 and CR line ends, the directory ``nodes``, a
``selection``, ``toggle_targets``, ``change_events`` and two snapshots.

Each view has a Spark SQL text and a DuckDB text that give equal rows; the DuckDB texts
are inlined as CTEs in front of every oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuspack.session import spread, write_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_LINE_MIX = """
    CASE WHEN (doc_id*7+pos) % 13 = 0 THEN concat('# ', line)
         WHEN (doc_id*7+pos) % 13 = 2 THEN concat('   // ', line)
         WHEN (doc_id*7+pos) % 13 = 4 THEN concat('  \"\"\"', line, '\"\"\"')
         WHEN (doc_id*7+pos) % 13 IN (6, 8) THEN concat('  \"\"\"', line)
         WHEN (doc_id*7+pos) % 13 = 10 THEN concat(line, ' ', repeat(chr(39), 3), ' ')
         ELSE line END AS ln"""

_PATH = """
  concat(source, '/', lang, '/',
    CASE WHEN doc_id % 29 = 0 THEN '.cache/' WHEN doc_id % 23 = 0 THEN '__pycache__/'
         WHEN doc_id % 19 = 0 THEN 'tests/' ELSE '' END,
    CASE WHEN doc_id % 31 = 0 THEN 'Test_' ELSE 'm' END, CAST(doc_id AS {str_t}),
    CASE doc_id % 16 WHEN 0 THEN '.py' WHEN 1 THEN '.cs' WHEN 2 THEN '.js' WHEN 3 THEN '.php'
      WHEN 4 THEN '.java' WHEN 5 THEN '.c' WHEN 6 THEN '.cpp' WHEN 7 THEN '.ts' WHEN 8 THEN '.go'
      WHEN 9 THEN '.rb' WHEN 10 THEN '.rs' WHEN 11 THEN '.swift' WHEN 12 THEN '.md'
      WHEN 13 THEN '' ELSE '.py' END) AS path"""

# The documented text of the view (explode every line, re-assemble per document).
SPARK_FILES_REFERENCE = f"""
WITH l AS (
  SELECT doc_id, source, lang, posexplode(split(text, '\\n')) AS (pos, line) FROM {{documents}}
), m AS (
  SELECT doc_id, source, lang, pos, {_LINE_MIX}
  FROM l
)
SELECT doc_id, source AS bundle, {_PATH.format(str_t='STRING')},
  concat_ws('\\n', transform(array_sort(collect_list(struct(pos, ln))), x -> x.ln)) AS content
FROM m GROUP BY doc_id, source, lang
"""

# Same rows, computed per document with a higher-order function: no explode, no shuffle.
# (A NULL text yields no lines and so no row, as in the text above.)
SPARK_FILES = f"""
SELECT doc_id, source AS bundle, {_PATH.format(str_t='STRING')},
  array_join(transform(split(text, '\\n'), (line, pos) -> {_LINE_MIX.replace(' AS ln', '')}), '\\n') AS content
FROM {{documents}} WHERE text IS NOT NULL
"""

DUCK_FILES = f"""
WITH l AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), m AS (
  SELECT doc_id, source, lang, pos, {_LINE_MIX}
  FROM l
)
SELECT doc_id, source AS bundle, {_PATH.format(str_t='VARCHAR')},
  string_agg(ln, chr(10) ORDER BY pos) AS content
FROM m GROUP BY doc_id, source, lang
"""

SPARK_RAW_FILES = """
SELECT doc_id, bundle, path,
  concat(CASE WHEN doc_id % 37 = 0 THEN x'FF' ELSE x'' END,
         encode(CASE doc_id % 5 WHEN 0 THEN replace(content, '\\n', '\\r\\n')
                                WHEN 1 THEN replace(content, '\\n', '\\r')
                                ELSE content END, 'UTF-8')) AS bytes
FROM {files}
"""

SPARK_NODES = """
SELECT bundle, path, false AS is_dir FROM {files}
UNION ALL
SELECT DISTINCT bundle, explode(transform(sequence(1, size(split(path, '/')) - 1),
  i -> array_join(slice(split(path, '/'), 1, i), '/'))) AS path, true AS is_dir FROM {files}
UNION ALL
SELECT DISTINCT bundle, concat(bundle, '/empty') AS path, true AS is_dir FROM {files}
"""

DUCK_NODES = """
SELECT bundle, path, false AS is_dir FROM files
UNION ALL
SELECT DISTINCT bundle, unnest(list_transform(range(1, len(string_split(path, '/'))),
  lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path, true AS is_dir FROM files
UNION ALL
SELECT DISTINCT bundle, concat(bundle, '/empty') AS path, true AS is_dir FROM files
"""

_SELECTION = """
SELECT path FROM {files} WHERE path LIKE '%.py' AND concat('/', path) NOT LIKE '%/.%'
  AND path NOT LIKE '%/__pycache__/%'
UNION ALL
SELECT DISTINCT concat(bundle, '/empty') AS path FROM {files}
WHERE CAST(replace(bundle, 'src', '') AS INT) % 2 = 0
"""

_TOGGLE_TARGETS = """
SELECT DISTINCT concat(bundle, '/de') AS path FROM {files}
WHERE bundle IN ('src0', 'src1', 'src2', 'src3', 'src4') AND path LIKE concat(bundle, '/de/%')
UNION ALL
SELECT path FROM {files} WHERE doc_id % 50 = 7
  AND NOT (bundle IN ('src0', 'src1', 'src2', 'src3', 'src4') AND path LIKE concat(bundle, '/de/%'))
"""

# FIXTURES' text joins the events with the one-row (max(doc_id) + 1); the same rows come
# from that value as a scalar subquery.
_CHANGE_EVENTS = """
SELECT e.event_id, e.ts, f.bundle AS root, f.path,
  CASE e.event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted'
                    WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS kind,
  e.event_id % 50 = 0 AS is_directory
FROM (SELECT *, event_id % (SELECT max(doc_id) + 1 FROM {documents}) AS doc_key FROM {events}) e
JOIN {files} f ON f.doc_id = e.doc_key
"""

_SNAPSHOT_A = "SELECT path, md5(content) AS content_hash FROM {files} WHERE doc_id % 10 <> 3"
_SNAPSHOT_B = """
SELECT path, md5(CASE WHEN doc_id % 10 = 5 THEN concat(content, 'x') ELSE content END) AS content_hash
FROM {files} WHERE doc_id % 10 <> 4
"""


# Second file set: web pages, one bundle per host, path = host + URL path + ".html".
_PAGE_FILES = r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS bundle,
  concat(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '.html')
    AS path,
  html AS content
FROM {pages}
"""

# Conversations: one bundle per conversation, one "file" per turn, in turn order.
_CONVERSATION_FILES = """
SELECT conv_id, concat('conv', CAST(conv_id AS {str_t})) AS bundle, turn AS seq,
  concat('conv', CAST(conv_id AS {str_t}), '/', lpad(CAST(turn AS {str_t}), 4, '0'), '-', role, '.md') AS path,
  text AS content
FROM {conversations}
"""


def _duck(text: str) -> str:
    return text.replace("{files}", "files").replace("{events}", "events").replace("{documents}", "documents")


DUCK_VIEWS = {
    "files": DUCK_FILES,
    "nodes": DUCK_NODES,
    "selection": _duck(_SELECTION),
    "toggle_targets": _duck(_TOGGLE_TARGETS),
    "change_events": _duck(_CHANGE_EVENTS),
    "snapshot_a": _duck(_SNAPSHOT_A),
    "snapshot_b": _duck(_SNAPSHOT_B),
    "page_files": _PAGE_FILES.replace("{pages}", "pages"),
    "conversation_files": _CONVERSATION_FILES.replace("{str_t}", "VARCHAR").replace("{conversations}", "conversations"),
}
# views each view reads (files first)
_DEPENDS = {
    "files": [],
    "nodes": ["files"],
    "selection": ["files"],
    "toggle_targets": ["files"],
    "change_events": ["files"],
    "snapshot_a": ["files"],
    "snapshot_b": ["files"],
    "page_files": [],
    "conversation_files": [],
}


def duck_with(sql: str, *views: str) -> str:
    """Prefix an oracle query with the CTEs of the derived views it reads."""
    need: list[str] = []
    for v in views:
        for dep in _DEPENDS[v] + [v]:
            if dep not in need:
                need.append(dep)
    ctes = ",\n".join(f"{v} AS (\n{DUCK_VIEWS[v].strip()}\n)" for v in need)
    return f"WITH {ctes}\n{sql.strip()}"


# (application id, data folder, view) -> folder of the written view
_STORED: dict[tuple[str, str, str], str] = {}


class Tables:
    """Lazily read driver tables and derived views for one ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def _view(self, name: str, text: str, stored: bool = False, **deps: DataFrame) -> DataFrame:
        """A derived view; ``stored`` ones (small, path-only, read by many branches of a
        plan) are written once per application and data folder to the shared folder and
        read back like the tables they stand for, instead of being re-derived in every
        branch and every query."""
        if name not in self._cache:
            if not stored:
                self._cache[name] = self.spark.sql(text, **deps)
            else:
                key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
                stored_df = None
                if key in _STORED:
                    try:
                        stored_df = self.spark.read.parquet(_STORED[key])
                    except Exception:  # the folder was cleaned up meanwhile: derive it again
                        stored_df = None
                if stored_df is None:
                    _STORED[key] = write_table(self.spark.sql(text, **deps), f"view-{name}")
                    stored_df = self.spark.read.parquet(_STORED[key])
                self._cache[name] = stored_df
        return self._cache[name]

    @property
    def files(self) -> DataFrame:
        return self._view("files", SPARK_FILES, documents=spread(self.table("documents"), "doc_id"))

    @property
    def raw_files(self) -> DataFrame:
        return self._view("raw_files", SPARK_RAW_FILES, files=self.files)

    @property
    def nodes(self) -> DataFrame:
        return self._view("nodes", SPARK_NODES, stored=True, files=self.files)

    @property
    def selection(self) -> DataFrame:
        return self._view("selection", _SELECTION, stored=True, files=self.files)

    @property
    def toggle_targets(self) -> DataFrame:
        return self._view("toggle_targets", _TOGGLE_TARGETS, stored=True, files=self.files)

    @property
    def change_events(self) -> DataFrame:
        return self._view(
            "change_events", _CHANGE_EVENTS,
            events=self.table("events"), documents=self.table("documents"), files=self.files,
        )

    @property
    def snapshot_a(self) -> DataFrame:
        return self._view("snapshot_a", _SNAPSHOT_A, files=self.files)

    @property
    def snapshot_b(self) -> DataFrame:
        return self._view("snapshot_b", _SNAPSHOT_B, files=self.files)

    @property
    def page_files(self) -> DataFrame:
        return self._view("page_files", _PAGE_FILES, pages=spread(self.table("pages"), "page_id"))

    @property
    def conversation_files(self) -> DataFrame:
        text = _CONVERSATION_FILES.replace("{str_t}", "STRING")
        return self._view("conversation_files", text, conversations=self.table("conversations"))
