"""DuckDB oracles of the schema-document queries."""

from storelens.plans.oracles import ORACLES
from storelens.plans.oracles_catalog import CAT_CTES


def _q(body: str) -> str:
    return "WITH " + CAT_CTES.strip() + "\n" + body


ORACLES["flatten_catalog"] = _q("""
SELECT store_id, source, source_pos, source_kind, "table", table_pos, "column", column_pos, type, primary_key,
       row_count, path, normalized, normalized_table, "column" AS samples FROM fx_cat""")

ORACLES["sanitize_catalog"] = _q("""
SELECT t.store_id, t.tables, CAST(c.n AS INTEGER) AS column_count,
       'max_length,name,nullable,precision,primary_key,scale,type' AS column_fields
FROM (SELECT store_id, string_agg("table", ',' ORDER BY source_pos, table_pos) AS tables
      FROM (SELECT DISTINCT store_id, source_pos, "table", table_pos FROM fx_cat) GROUP BY store_id) t
JOIN (SELECT store_id, count(*) AS n FROM fx_cat GROUP BY store_id) c ON c.store_id = t.store_id""")

ORACLES["scan_schema_docs"] = _q("""
SELECT store_id, NOT (CAST(substr(store_id, 5) AS BIGINT) % 50 = 0) AS valid,
       CASE WHEN CAST(substr(store_id, 5) AS BIGINT) % 50 = 0 THEN NULL ELSE count(DISTINCT "table") END AS table_count,
       CASE WHEN CAST(substr(store_id, 5) AS BIGINT) % 50 = 0 THEN NULL ELSE count(*) END AS column_count
FROM fx_cat GROUP BY store_id""")

ORACLES["merge_catalogs"] = _q("""
SELECT c.store_id, CAST(count(DISTINCT source_pos * 2 + table_pos % 2) AS INTEGER) AS source_count,
       CAST(count(DISTINCT "table") AS INTEGER) AS table_count, CAST(count(*) AS INTEGER) AS column_count,
       any_value(s.requires_confirmation) AS requires_mapping_confirmation
FROM fx_cat c JOIN fx_stores s ON s.store_id = c.store_id GROUP BY c.store_id""")

ORACLES["catalog_from_metadata"] = _q("""
SELECT c.store_id, c."table", CAST(p.table_pos AS INTEGER) AS table_pos, c."column", c.column_pos, c.type,
       c.primary_key, c.row_count, NOT c.primary_key AS nullable
FROM fx_cat c
JOIN (SELECT store_id, "table", row_number() OVER (PARTITION BY store_id ORDER BY split_part("table", '.', 1),
             split_part("table", '.', 2)) - 1 AS table_pos
      FROM (SELECT DISTINCT store_id, "table" FROM fx_cat WHERE source_kind = 'sqlserver')) p
  ON p.store_id = c.store_id AND p."table" = c."table"
WHERE c.source_kind = 'sqlserver'""")

ORACLES["catalog_relationships"] = _q("""
SELECT store_id, 'sqlserver' AS source, 'declared_foreign_key' AS kind,
       'FK_' || replace(from_table, '.', '_') || '_' || from_column AS "constraint",
       from_table, from_column, to_table, to_column, 1.0::DOUBLE AS confidence FROM fx_fks""")

ORACLES["sample_rows"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5"""

ORACLES["select_source"] = _q("""
SELECT store_id, CASE WHEN c_custkey % 2 = 0 THEN 'store_sql' ELSE 'archive_sql' END AS name,
       c_custkey % 2 = 0 AS exact_match
FROM fx_stores""")

ORACLES["system_catalog"] = ORACLES["catalog_from_metadata"]
ORACLES["system_catalog_relationships"] = ORACLES["catalog_relationships"]
