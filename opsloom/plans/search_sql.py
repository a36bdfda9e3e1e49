"""Search functions for SQL users: table functions over a view of chunks.

    register_search(spark, "chunks")
    SELECT * FROM lexical_search('payment terms', 5, project => 'north');
    SELECT * FROM semantic_search(array(0.1D, ...), channel => 'web');

They are SQL all through, so Catalyst inlines them: filters that are not given
fold away, and the rank limit reaches the scan's tasks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from opsloom import fixed_values as fv


def _list(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


_WORDS = f"transform(regexp_extract_all(coalesce({{0}}, ''), r'({fv.TOKEN_PATTERN})', 1), x -> lower(x))"
_TOKENS = f"filter({_WORDS}, t -> NOT array_contains({_list(sorted(fv.STOPWORDS))}, t))"

#: Cover density: every minimal passage with all query words adds 0.1 / (1 + noise words in it).
_COVER = f"""
element_at(transform(array(array_sort(array_distinct({_TOKENS.format('query')}))), wanted ->
  IF(size(wanted) = 0 OR size(array_intersect({_TOKENS.format('body')}, wanted)) < size(wanted), CAST(NULL AS DOUBLE),
    element_at(transform(array(filter(transform({_WORDS.format('body')},
        (w, i) -> named_struct('p', i, 't', CAST(array_position(wanted, w) AS INT) - 1)), h -> h.t >= 0)), hits ->
      aggregate(sequence(0, size(hits) - 1), named_struct('seen', array_repeat(-1, size(wanted)), 'score', 0.0D),
        (s, n) -> element_at(transform(array(transform(s.seen, (last, i) -> IF(i = hits[n].t, n, last))), seen ->
          named_struct('seen', seen, 'score', s.score + IF(array_min(seen) >= 0 AND s.seen[hits[n].t] < array_min(seen),
            {fv.COVER_WEIGHT}D / (1 + hits[n].p - hits[array_min(seen)].p - (n - array_min(seen))), 0.0D))), 1),
        s -> s.score)), 1))), 1)
"""

_DOT = "aggregate(zip_with({0}, {1}, (a, b) -> CAST(a AS DOUBLE) * CAST(b AS DOUBLE)), 0.0D, (s, x) -> s + x)"


def register_search(spark: SparkSession, view: str, id_type: str = "BIGINT") -> None:
    """Make ``lexical_search`` and ``semantic_search`` over a temporary view.

    The view has chunk_id, body, embedding, project and channel. Both functions
    take the query, k (8 if not given, NULL or 0; a negative one is refused)
    and optional filters by project and channel. Lexical: all query words
    occur, best cover density first, ties by id falling. Semantic: smallest
    cosine distance first, ties by id falling; chunks without vector take no part.
    """
    def kept(name: str) -> str:      # an argument is named with its function, as columns of the view come first
        return " AND ".join(f"({name}.{c} IS NULL OR c.{c} = {name}.{c})" for c in ("project", "channel"))

    limit = f"rank_position <= IF(k < 0, raise_error('k must not be negative'), IF(coalesce(k, 0) = 0, {fv.CATALOG_TOP_K}, k))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION lexical_score(body STRING, query STRING) RETURNS DOUBLE RETURN {_COVER}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_distance(one ARRAY<DOUBLE>, two ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
              f"1 - {_DOT.format('one', 'two')} / (sqrt({_DOT.format('one', 'one')}) * sqrt({_DOT.format('two', 'two')}))")
    arguments = f"k INT DEFAULT {fv.CATALOG_TOP_K}, project STRING DEFAULT NULL, channel STRING DEFAULT NULL"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION lexical_search(query STRING, {arguments})
        RETURNS TABLE (chunk_id {id_type}, score FLOAT, rank_position INT)
        RETURN SELECT chunk_id, score, rank_position FROM (
            SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id DESC) AS rank_position FROM (
                SELECT c.chunk_id, CAST(lexical_score(c.body, query) AS FLOAT) AS score FROM {view} c WHERE {kept('lexical_search')})
            WHERE score IS NOT NULL) WHERE {limit}""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION semantic_search(query ARRAY<DOUBLE>, {arguments})
        RETURNS TABLE (chunk_id {id_type}, distance DOUBLE, rank_position INT)
        RETURN SELECT chunk_id, distance, rank_position FROM (
            SELECT chunk_id, distance, row_number() OVER (ORDER BY distance, chunk_id DESC) AS rank_position FROM (
                SELECT c.chunk_id, vector_distance(CAST(c.embedding AS ARRAY<DOUBLE>), query) AS distance FROM {view} c
                WHERE c.embedding IS NOT NULL AND {kept('semantic_search')})) WHERE {limit}""")
