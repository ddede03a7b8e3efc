"""The query catalogue: graph text over the star graph, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.catalog import ForeignKey
from quillgraph.evaluation import execution_accuracy, rollup
from quillgraph.functions.expressions import Compiler, attribute_string, cosine, numeric_similarity
from quillgraph.operators.ordered import collected
from quillgraph.operators.recursion import closure
from quillgraph.operators.relational import (
    cardinality_violations, cluster_by, constraint_violations, degrees, distinct_on, distribute_by, label_frequency, missing_ends, pivoted, similarity_matrix, similarity_top_k,
    sort_by, top_k, unique_repaired, unique_violations, unpivoted,
)
from quillgraph.plans import ir
from quillgraph.plans.build import col, func, select, star, table
from quillgraph.plans.engine import Engine
from quillgraph.plans.rel2graph import Edge, Join, Table, join_frames, pattern
from quillgraph.plans.rel2graph import query as join_query
from quillgraph.sources.fixtures import star_graph
from quillgraph.sources.ingest import coerced, declared_type, fk_edges, jt_edges
from quillgraph.streaming.events import checkpoint_folder, read_events, sessions, streamed, windowed_counts

#: name -> (graph text, dialect, match mode, SQL)
TEXTS: dict[str, tuple[str, str, str, str]] = {}


def _add(name: str, text: str, sql: str, dialect: str = "cypher", match_mode: str = "trail") -> None:
    TEXTS[name] = (text, dialect, match_mode, sql)


FLAGSHIP = (
    "MATCH (c:Customer)-[p:PLACED]->(o:Orders), (c)-[l:CUSTOMER_IN]->(n:Nation) WHERE o.o_totalprice > 100000 "
    "RETURN n.n_name AS nation, COUNT(o) AS k ORDER BY k DESC, nation LIMIT 5"
)
_add("flagship", FLAGSHIP, "SELECT n_name AS nation, count(*) AS k FROM customer JOIN orders ON o_custkey=c_custkey JOIN nation ON n_nationkey=c_nationkey WHERE o_totalprice>100000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")

# Patterns
_add("node_scan_filter", "MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_custkey AS c, c.c_acctbal AS b", "SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal>5000")
_add("one_hop", "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_name AS c, o.o_totalprice AS p", "SELECT c_name AS c, o_totalprice AS p FROM customer JOIN orders ON o_custkey=c_custkey")
_add("one_hop_reverse", "MATCH (o:Orders)<-[:PLACED]-(c:Customer) RETURN o.o_orderkey AS o, c.c_custkey AS c", "SELECT o_orderkey AS o, o_custkey AS c FROM orders")
_add("undirected", "MATCH (a:Nation)-[:IN_REGION]-(b:Region) RETURN a.n_name AS a, b.r_name AS b", "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey=r_regionkey")
_add("edge_alternation", "MATCH (x)-[:CUSTOMER_IN|SUPPLIER_IN]->(n:Nation) RETURN n.n_name AS n, count(*) AS k", "SELECT n_name AS n, count(*) AS k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON n_nationkey=k GROUP BY 1")
_add("unlabelled_nodes", "MATCH (x)-[r:IN_REGION]->(y) RETURN x.n_name AS a, y.r_name AS b, type(r) AS t", "SELECT n_name AS a, r_name AS b, 'IN_REGION' AS t FROM nation JOIN region ON n_regionkey=r_regionkey")
_add("two_hop", "MATCH (c:Customer)-[:PLACED]->(o)-[r:CONTAINS]->(p:Part) WHERE p.p_size > 45 RETURN c.c_custkey AS c, p.p_partkey AS p, r.l_quantity AS q", "SELECT o_custkey AS c, p_partkey AS p, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey WHERE p_size>45")
_add("three_hop", "MATCH (n:Nation)<-[:CUSTOMER_IN]-(c)-[:PLACED]->(o)-[:FULFILLED_BY]->(s:Supplier) RETURN n.n_name AS n, s.s_name AS s, count(*) AS k", "SELECT n_name AS n, s_name AS s, count(*) AS k FROM nation JOIN customer ON c_nationkey=n_nationkey JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON s_suppkey=l_suppkey GROUP BY 1,2")
_add("four_hop", "MATCH (r:Region)<-[:IN_REGION]-(n)<-[:CUSTOMER_IN]-(c)-[:PLACED]->(o)-[e:CONTAINS]->(p:Part) RETURN r.r_name AS r, p.p_brand AS b, count(*) AS k, round(sum(e.l_quantity), 2) AS q", "SELECT r_name AS r, p_brand AS b, count(*) AS k, round(sum(l_quantity),2) AS q FROM region JOIN nation ON n_regionkey=r_regionkey JOIN customer ON c_nationkey=n_nationkey JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey GROUP BY 1,2")
_add("five_hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:CUSTOMER_IN]-(c)-[:PLACED]->(o)-[:FULFILLED_BY]->(s)-[:SUPPLIER_IN]->(m:Nation) RETURN r.r_name AS r, m.n_name AS m, count(*) AS k", "SELECT r_name AS r, m.n_name AS m, count(*) AS k FROM region JOIN nation n ON n.n_regionkey=r_regionkey JOIN customer ON c_nationkey=n.n_nationkey JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON s_suppkey=l_suppkey JOIN nation m ON m.n_nationkey=s_nationkey GROUP BY 1,2")
_add("cycle_closed", "MATCH (c:Customer)-[:PLACED]->(:Orders)-[:FULFILLED_BY]->(:Supplier)-[:SUPPLIER_IN]->(n)<-[:CUSTOMER_IN]-(c) RETURN c.c_custkey AS c, n.n_name AS n", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON s_suppkey=l_suppkey JOIN nation ON n_nationkey=s_nationkey AND n_nationkey=c_nationkey")
_add("edge_only", "MATCH ()-[r:CONTAINS]->() RETURN r.l_quantity AS q, r.l_returnflag AS f", "SELECT l_quantity AS q, l_returnflag AS f FROM lineitem")
_add("cartesian_nodes", "MATCH (r:Region),(n:Nation) RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation")
_add("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > 450000 RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice>450000")
_add("optional_two_hop", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:SUPPLIER_IN]-(s:Supplier)<-[:FULFILLED_BY]-(o:Orders) WHERE o.o_totalprice > 480000 AND s.s_acctbal < 0 RETURN n.n_name AS n, count(o) AS k", "SELECT n_name AS n, count(o_orderkey) AS k FROM nation LEFT JOIN (supplier JOIN lineitem ON l_suppkey=s_suppkey JOIN orders ON o_orderkey=l_orderkey) ON s_nationkey=n_nationkey AND o_totalprice>480000 AND s_acctbal<0 GROUP BY 1")
_add("path_length", "MATCH p=(c:Customer)-[:PLACED]->(o:Orders)-[:CONTAINS]->(x:Part) RETURN c.c_custkey AS c, LENGTH(p) AS l", "SELECT o_custkey AS c, CAST(2 AS INTEGER) AS l FROM orders JOIN lineitem ON l_orderkey=o_orderkey")
_add("trails", "MATCH (a:Part)<-[r1:CONTAINS]-(o)-[r2:CONTAINS]->(b:Part) RETURN a.p_partkey AS a, b.p_partkey AS b", "WITH l AS (SELECT *, row_number() OVER () AS i FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b FROM l x JOIN l y ON x.l_orderkey=y.l_orderkey AND x.i<>y.i")
_add("walks", "MATCH (a:Part)<-[r1:CONTAINS]-(o)-[r2:CONTAINS]->(b:Part) RETURN a.p_partkey AS a, b.p_partkey AS b", "SELECT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey=y.l_orderkey", match_mode="walk")
_add("two_matches", "MATCH (c:Customer)-[:CUSTOMER_IN]->(n:Nation) WHERE n.n_name STARTS WITH 'A' OR n.n_regionkey = 1 MATCH (c)-[:PLACED]->(o:Orders) RETURN n.n_nationkey AS n, count(o) AS k", "SELECT n_nationkey AS n, count(*) AS k FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN orders ON o_custkey=c_custkey WHERE n_name LIKE 'A%' OR n_regionkey=1 GROUP BY 1")
_add("gql_match", "MATCH (c@`Customer`)-[p@`PLACED`]->(o@`Orders`) WHERE o.o_totalprice > 400000 RETURN c.c_mktsegment AS seg, COUNT(*) AS k GROUP BY c.c_mktsegment NEXT FILTER WHERE k > 1 RETURN seg, k", "SELECT c_mktsegment AS seg, count(*) AS k FROM customer JOIN orders ON o_custkey=c_custkey WHERE o_totalprice>400000 GROUP BY 1 HAVING count(*)>1", dialect="gql")

_add("several_labels", "MATCH (x:Customer:Supplier) RETURN x.c_custkey AS c, x.s_name AS s", "SELECT c_custkey AS c, s_name AS s FROM customer JOIN supplier ON c_custkey=s_suppkey")

# Predicates
_add("like_ci", "MATCH (p:Part) WHERE like(p.p_name, '%WIDGET%') RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_name ILIKE '%WIDGET%'")
_add("like_cs", "MATCH (p:Part) WHERE like(p.p_type, '%A%') RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_type LIKE '%A%'", dialect="gql")
_add("regex_full", "MATCH (c:Customer) WHERE c.c_name =~ '.*[02468]$' RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE regexp_full_match(c_name, '.*[02468]')")
_add("text_tests", "MATCH (c:Customer) RETURN c.c_custkey AS c, c.c_name CONTAINS '12' AS a, c.c_name STARTS WITH 'Cust' AS b, c.c_name ENDS WITH '7' AS d", "SELECT c_custkey AS c, contains(c_name,'12') AS a, starts_with(c_name,'Cust') AS b, ends_with(c_name,'7') AS d FROM customer")
_add("in_list", "MATCH (n:Nation) WHERE n.n_regionkey IN [1, 3] RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_regionkey IN (1,3)")
_add("not_in", "MATCH (n:Nation) WHERE NOT n.n_regionkey IN [1, 3] RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_regionkey NOT IN (1,3)")
_add("between", "MATCH (o:Orders) WHERE o.o_totalprice BETWEEN 1000 AND 50000 RETURN o.o_orderkey AS o", "SELECT o_orderkey AS o FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
_add("is_null", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > 450000 WITH c, o WHERE o.o_orderkey IS NULL RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice>450000 WHERE o_orderkey IS NULL")
_add("bool_nest", "MATCH (c:Customer) WHERE NOT (c.c_acctbal < 0 OR c.c_nationkey = 3) AND (c.c_mktsegment = 'BUILDING' XOR c.c_acctbal > 5000) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT (c_acctbal<0 OR c_nationkey=3) AND ((c_mktsegment='BUILDING') <> (c_acctbal>5000))")
_add("not_equal_prec", "MATCH (c:Customer) WHERE NOT c.c_nationkey = 3 RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_nationkey<>3")
_add("in_subquery", "MATCH (c:Customer) WHERE c.c_nationkey IN COLLECT { MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = 'ASIA' RETURN n.n_nationkey AS k } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA')")
_add("not_in_subquery", "MATCH (c:Customer) WHERE NOT c.c_custkey IN COLLECT { MATCH (o:Orders) WHERE o.o_totalprice > 400000 RETURN o.o_custkey AS k } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice>400000)")
_add("let_value", "LET ks = VALUE { MATCH (n@Nation) WHERE n.n_regionkey = 1 RETURN n.n_nationkey AS k } MATCH (s@Supplier) WHERE s.s_nationkey IN ks RETURN s.s_suppkey AS s", "SELECT s_suppkey AS s FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey=1)", dialect="gql")
_add("exists", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 450000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>450000)")
_add("not_exists", "MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > c.c_acctbal * 50 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>c_acctbal*50)")
_add("exists_or", "MATCH (c:Customer) WHERE c.c_acctbal > 9000 OR EXISTS { MATCH (c)-[:PLACED]->(o:Orders)-[:FULFILLED_BY]->(s:Supplier) WHERE s.s_acctbal < 0 AND o.o_totalprice > 400000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal>9000 OR EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON s_suppkey=l_suppkey WHERE o_custkey=c_custkey AND s_acctbal<0 AND o_totalprice>400000)")
_add("scalar_sub", "MATCH (c:Customer) WHERE c.c_acctbal > VALUE { MATCH (x:Customer) RETURN avg(x.c_acctbal) AS a } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
_add("scalar_sub_select", "MATCH (r:Region) RETURN r.r_name AS r, VALUE { MATCH (x:Customer) RETURN max(x.c_acctbal) AS a } AS m", "SELECT r_name AS r, (SELECT max(c_acctbal) FROM customer) AS m FROM region")
_add("derived_table", "CALL (*) { MATCH (n:Nation) RETURN n.n_name AS nm, n.n_nationkey AS nk } MATCH (c:Customer) WHERE c.c_nationkey = nk RETURN nm, count(c) AS k", "SELECT n_name AS nm, count(*) AS k FROM (SELECT n_name, n_nationkey FROM nation) JOIN customer ON c_nationkey=n_nationkey GROUP BY 1")
_add("cte", "CALL (*) { MATCH (o:Orders) WITH o.o_custkey AS ck, sum(o.o_totalprice) AS total RETURN ck, round(total, 2) AS total } CALL (*) { MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_custkey AS k } WITH * WHERE ck = k RETURN ck, total", "WITH t AS (SELECT o_custkey AS ck, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1), u AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal>5000) SELECT ck, total FROM t JOIN u ON ck=k")

_add("correlated_scalar", "MATCH (c:Customer) RETURN c.c_custkey AS c, VALUE { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 400000 RETURN count(o) AS n } AS n", "SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey AND o_totalprice>400000) AS n FROM customer")
_add("correlated_scalar_where", "MATCH (c:Customer) WHERE c.c_acctbal > VALUE { MATCH (x:Customer) WHERE x.c_nationkey = c.c_nationkey RETURN avg(x.c_acctbal) AS a } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer c WHERE c_acctbal > (SELECT avg(x.c_acctbal) FROM customer x WHERE x.c_nationkey=c.c_nationkey)")
_add("optional_exists", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:SUPPLIER_IN]-(s:Supplier) WHERE EXISTS { MATCH (c:Customer) WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey = s.s_suppkey } RETURN n.n_name AS n, s.s_suppkey AS s", "SELECT n_name AS n, s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey=n_nationkey AND c_custkey=s_suppkey)")
_add("in_mixed", "MATCH (n:Nation) WHERE n.n_nationkey IN ['3', 5, 7.0, 'none'] RETURN n.n_nationkey AS n", "SELECT n_nationkey AS n FROM nation WHERE n_nationkey IN (3, 5, 7)")
_add("xor", "MATCH (n:Nation) WHERE n.n_regionkey = 1 XOR n.n_nationkey < 5 RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE (n_regionkey=1) <> (n_nationkey<5)")
_add("return_star", "MATCH (r:Region) WITH r.r_regionkey AS k, r.r_name AS n RETURN *", "SELECT r_regionkey AS k, r_name AS n FROM region")
_add("nested_subqueries", "MATCH (c:Customer) WHERE c.c_nationkey IN COLLECT { MATCH (n:Nation) WHERE n.n_regionkey IN COLLECT { MATCH (r:Region) WHERE r.r_name STARTS WITH 'A' RETURN r.r_regionkey AS k } RETURN n.n_nationkey AS k } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))")
_add("unwind", "UNWIND [1, 3, 99] AS k MATCH (r:Region) WHERE r.r_regionkey = k RETURN k, r.r_name AS n", "SELECT r_regionkey AS k, r_name AS n FROM region WHERE r_regionkey IN (1,3)")

# Conditions
_add("case_searched", "MATCH (c:Customer) RETURN c.c_custkey AS c, CASE WHEN c.c_acctbal < 0 THEN 'debt' WHEN c.c_acctbal < 5000 THEN 'some' ELSE 'much' END AS w", "SELECT c_custkey AS c, CASE WHEN c_acctbal<0 THEN 'debt' WHEN c_acctbal<5000 THEN 'some' ELSE 'much' END AS w FROM customer")
_add("case_simple", "MATCH (o:Orders) RETURN o.o_orderkey AS o, CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS s", "SELECT o_orderkey AS o, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS s FROM orders")
_add("iif", "MATCH (c:Customer) RETURN c.c_custkey AS c, iif(c.c_acctbal > 0, 'pos', 'neg') AS s, iif(c.c_nationkey > 10, 'hi') AS h", "SELECT c_custkey AS c, CASE WHEN c_acctbal>0 THEN 'pos' ELSE 'neg' END AS s, CASE WHEN c_nationkey>10 THEN 'hi' END AS h FROM customer")
_add("number_as_condition", "MATCH (n:Nation) WHERE n.n_regionkey AND NOT n.n_nationkey RETURN n.n_name AS n UNION ALL MATCH (n:Nation) WHERE n.n_regionkey RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_regionkey<>0 AND NOT n_nationkey<>0 UNION ALL SELECT n_name FROM nation WHERE n_regionkey<>0")

# Aggregation
_add("group_by", "MATCH (o:Orders) WITH o.o_orderstatus AS s, count(*) AS k, max(o.o_totalprice) AS m RETURN s, k, m", "SELECT o_orderstatus AS s, count(*) AS k, max(o_totalprice) AS m FROM orders GROUP BY 1")
_add("implicit_group", "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_mktsegment AS s, o.o_orderstatus AS t, round(avg(o.o_totalprice), 4) AS a, count(o) AS k", "SELECT c_mktsegment AS s, o_orderstatus AS t, round(avg(o_totalprice),4) AS a, count(*) AS k FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1,2")
_add("having", "MATCH (c:Customer) WITH c.c_nationkey AS k, count(*) AS n WHERE n > 60 RETURN k, n", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*)>60")
_add("count_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_nationkey AS n, count(DISTINCT c.c_custkey) AS k, count(DISTINCT o.o_orderpriority) AS p", "SELECT c_nationkey AS n, count(DISTINCT c_custkey) AS k, count(DISTINCT o_orderpriority) AS p FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1")
_add("sum_bool", "MATCH (c:Customer) RETURN c.c_mktsegment AS s, sum(c.c_acctbal > 5000) AS k", "SELECT c_mktsegment AS s, CAST(sum(CASE WHEN c_acctbal>5000 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM customer GROUP BY 1")
_add("global_agg", "MATCH (p:Part) RETURN count(*) AS k, min(p.p_retailprice) AS a, max(p.p_retailprice) AS b, round(avg(p.p_size), 4) AS m", "SELECT count(*) AS k, min(p_retailprice) AS a, max(p_retailprice) AS b, round(avg(p_size),4) AS m FROM part")
_add("empty_agg", "MATCH (p:Part) WHERE p.p_size > 1000 RETURN count(*) AS k, max(p.p_retailprice) AS b", "SELECT count(*) AS k, max(p_retailprice) AS b FROM part WHERE p_size>1000")
_add("return_distinct", "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS s, c.c_nationkey AS n", "SELECT DISTINCT c_mktsegment AS s, c_nationkey AS n FROM customer")
_add("group_concat", "MATCH (n:Nation) RETURN n.n_regionkey AS r, group_concat(n.n_name, '|') AS names", "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1")
_add("agg_expression", "MATCH (o:Orders) RETURN o.o_orderpriority AS p, round(max(o.o_totalprice) - min(o.o_totalprice), 2) AS spread, count(*) * 2 AS twice", "SELECT o_orderpriority AS p, round(max(o_totalprice)-min(o_totalprice),2) AS spread, count(*)*2 AS twice FROM orders GROUP BY 1")
_add("agg_in_order", "MATCH (c:Customer) RETURN c.c_nationkey AS n ORDER BY count(c) DESC, c.c_nationkey LIMIT 4", "SELECT c_nationkey AS n FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4")
_add("group_node", "MATCH (n:Nation)<-[:CUSTOMER_IN]-(c) WITH n, count(c) AS k MATCH (n)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, n.n_name AS n, k", "SELECT r_name AS r, n_name AS n, k FROM (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey")

_add("collect_sorted", "MATCH (n:Nation) RETURN n.n_regionkey AS r, join(sort(collect(n.n_nationkey)), ',') AS ks, size(collect(DISTINCT n.n_regionkey)) AS one", "SELECT n_regionkey AS r, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS ks, CAST(1 AS BIGINT) AS one FROM nation GROUP BY 1")
_add("rollup_text", "MATCH (o:Orders) RETURN o.o_orderstatus AS s, o.o_orderpriority AS p, count(*) AS k, max(o.o_totalprice) AS m GROUP BY ROLLUP (o.o_orderstatus, o.o_orderpriority)", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS k, max(o_totalprice) AS m FROM orders GROUP BY ROLLUP(1,2)")
_add("cube_text", "MATCH (c:Customer) RETURN c.c_nationkey AS n, c.c_mktsegment AS s, count(*) AS k GROUP BY CUBE (c.c_nationkey, c.c_mktsegment)", "SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS k FROM customer GROUP BY CUBE(1,2)")
_add("grouping_sets_text", "MATCH (c:Customer) RETURN c.c_nationkey AS n, c.c_mktsegment AS s, count(*) AS k GROUP BY GROUPING SETS ((c.c_nationkey), (c.c_mktsegment), ())", "SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS k FROM customer GROUP BY GROUPING SETS ((1),(2),())")

# Windows
_add("named_window", "MATCH (c:Customer) RETURN c.c_custkey AS c, max(c.c_acctbal) OVER w AS m, count(*) OVER w AS k WINDOW w AS (PARTITION BY c.c_nationkey)", "SELECT c_custkey AS c, max(c_acctbal) OVER w AS m, count(*) OVER w AS k FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
_add("qualify_clause", "MATCH (o:Orders) RETURN o.o_custkey AS c, o.o_orderkey AS o QUALIFY row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_totalprice, o.o_orderkey) = 1", "SELECT o_custkey AS c, o_orderkey AS o FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1")
_add("rank", "MATCH (c:Customer) RETURN c.c_custkey AS c, rank() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_acctbal DESC) AS r", "SELECT c_custkey AS c, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INTEGER) AS r FROM customer")
_add("row_number", "MATCH (o:Orders) RETURN o.o_orderkey AS o, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS r", "SELECT o_orderkey AS o, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders")
_SHARED = "MATCH (a:Part)<-[x:CONTAINS]-(o:Orders)-[y:CONTAINS]->(b:Part) WHERE a.p_partkey = r.node AND o.o_totalprice > 400000"
_add("recursive_text", "WITH RECURSIVE reached AS { MATCH (p:Part) WHERE p.p_partkey % 50 = 1 RETURN p.p_partkey AS start, p.p_partkey AS node UNION FROM reached AS r " + _SHARED + " RETURN r.start AS start, b.p_partkey AS node } FROM reached AS z RETURN z.start AS start, z.node AS node", "WITH RECURSIVE big AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey=l_orderkey WHERE o_totalprice > 400000), hop AS (SELECT DISTINCT x.p AS a, y.p AS b FROM big x JOIN big y ON x.o=y.o), reached(start, node) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 50 = 1 UNION SELECT start, b FROM reached JOIN hop ON a=node) SELECT start, node FROM reached")
_add("recursive_counts", "WITH RECURSIVE steps AS { MATCH (r:Region) RETURN r.r_regionkey AS k, 0 AS n UNION ALL FROM steps AS s MATCH (m:Nation) WHERE m.n_regionkey = s.k AND s.n < 2 RETURN m.n_nationkey % 5 AS k, s.n + 1 AS n } FROM steps AS z RETURN z.n AS n, z.k AS k, count(*) AS c", "WITH RECURSIVE steps(k, n) AS (SELECT r_regionkey, 0 FROM region UNION ALL SELECT n_nationkey % 5, n + 1 FROM steps JOIN nation ON n_regionkey=k WHERE n < 2) SELECT n, k, count(*) AS c FROM steps GROUP BY 1, 2")
_add("count_block", "MATCH (c:Customer) RETURN c.c_custkey AS c, COUNT { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 200000 } AS n", "SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey AND o_totalprice>200000) AS n FROM customer")
_add("count_block_filter", "MATCH (n:Nation) WHERE COUNT { MATCH (n)<-[:CUSTOMER_IN]-(c) } > COUNT { MATCH (n)<-[:SUPPLIER_IN]-(s) RETURN DISTINCT s.s_nationkey AS k } + 1 RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE (SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey) > (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey=n_nationkey) + 1")
_add("correlated_group", "MATCH (n:Nation) RETURN n.n_name AS n, VALUE { MATCH (n)<-[:CUSTOMER_IN]-(c:Customer) WITH c.c_mktsegment AS s, count(*) AS k RETURN max(k) AS m } AS m", "SELECT n_name AS n, (SELECT max(k) FROM (SELECT count(*) AS k FROM customer WHERE c_nationkey=n_nationkey GROUP BY c_mktsegment)) AS m FROM nation")
_add("correlated_expression", "MATCH (c:Customer) RETURN c.c_custkey AS c, VALUE { MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > 200000 RETURN round(max(o.o_totalprice) - c.c_acctbal, 2) AS x } AS x, VALUE { MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > 200000 RETURN count(o) + 100 * c.c_nationkey AS y } AS y", "SELECT c_custkey AS c, round((SELECT max(o_totalprice) FROM orders WHERE o_custkey=c_custkey AND o_totalprice>200000) - c_acctbal, 2) AS x, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey AND o_totalprice>200000) + 100 * c_nationkey AS y FROM customer")
_add("correlated_first", "MATCH (c:Customer) RETURN c.c_custkey AS c, VALUE { MATCH (c)-[:PLACED]->(o) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 1 } AS o", "SELECT c_custkey AS c, (SELECT o_orderkey FROM orders WHERE o_custkey=c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS o FROM customer")
_add("rank_global", "MATCH (o:Orders) RETURN o.o_orderkey AS o, rank() OVER (ORDER BY o.o_orderdate) AS r, dense_rank() OVER (ORDER BY o.o_orderdate) AS d, row_number() OVER (ORDER BY o.o_totalprice DESC, o.o_orderkey) AS n", "SELECT o_orderkey AS o, rank() OVER (ORDER BY o_orderdate) AS r, dense_rank() OVER (ORDER BY o_orderdate) AS d, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders")
_add("running_sum_global", "MATCH (c:Customer) RETURN c.c_custkey AS c, sum(c.c_nationkey) OVER (ORDER BY c.c_acctbal) AS s, count(*) OVER (ORDER BY c.c_mktsegment) AS k, max(c.c_acctbal) OVER (ORDER BY c.c_mktsegment) AS m, round(avg(c.c_nationkey) OVER (ORDER BY c.c_acctbal), 6) AS a", "SELECT c_custkey AS c, CAST(sum(c_nationkey) OVER (ORDER BY c_acctbal) AS BIGINT) AS s, count(*) OVER (ORDER BY c_mktsegment) AS k, max(c_acctbal) OVER (ORDER BY c_mktsegment) AS m, round(avg(c_nationkey) OVER (ORDER BY c_acctbal), 6) AS a FROM customer")
_add("lag_global", "MATCH (o:Orders) RETURN o.o_orderkey AS o, lag(o.o_totalprice) OVER (ORDER BY o.o_orderdate, o.o_orderkey) AS b, lead(o.o_orderkey, 3) OVER (ORDER BY o.o_orderdate, o.o_orderkey) AS f", "SELECT o_orderkey AS o, lag(o_totalprice) OVER w AS b, lead(o_orderkey, 3) OVER w AS f FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)")
_add("window_sum", "MATCH (c:Customer) RETURN c.c_custkey AS c, count(*) OVER (PARTITION BY c.c_nationkey) AS k, max(c.c_acctbal) OVER (PARTITION BY c.c_mktsegment) AS m", "SELECT c_custkey AS c, count(*) OVER (PARTITION BY c_nationkey) AS k, max(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m FROM customer")
_add("qualify", "MATCH (o:Orders) WITH o.o_custkey AS c, o.o_orderkey AS o, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS r WHERE r <= 3 RETURN c, o, r", "SELECT o_custkey AS c, o_orderkey AS o, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders QUALIFY r<=3")

# Order and limit
_add("order_nulls", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > 480000 RETURN c.c_custkey AS c, o.o_totalprice AS p ORDER BY p DESC NULLS FIRST, c LIMIT 20", "SELECT c_custkey AS c, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice>480000 ORDER BY p DESC NULLS FIRST, c LIMIT 20")
_add("order_multi", "MATCH (p:Part) RETURN p.p_partkey AS p, p.p_size AS s ORDER BY s DESC, p ASC LIMIT 15", "SELECT p_partkey AS p, p_size AS s FROM part ORDER BY s DESC, p LIMIT 15")
_add("pre_order", "MATCH (o:Orders) ORDER BY o.o_totalprice DESC, o.o_orderkey RETURN o.o_custkey AS c, o.o_orderstatus AS s LIMIT 10", "SELECT o_custkey AS c, o_orderstatus AS s FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_add("order_hidden", "MATCH (c:Customer) RETURN c.c_name AS n ORDER BY c.c_acctbal * -1, c.c_custkey LIMIT 8", "SELECT c_name AS n FROM customer ORDER BY c_acctbal * -1, c_custkey LIMIT 8")
_add("skip_limit", "MATCH (c:Customer) RETURN c.c_custkey AS c ORDER BY c SKIP 10 LIMIT 5", "SELECT c_custkey AS c FROM customer ORDER BY 1 LIMIT 5 OFFSET 10")
_add("null_order_emulated", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > 480000 RETURN c.c_custkey AS c, o.o_orderkey AS o ORDER BY o IS NULL DESC, o, c LIMIT 12", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice>480000 ORDER BY (o_orderkey IS NULL) DESC, o, c LIMIT 12")

# Set operations
_NAMES = ("MATCH (n:Nation) WHERE n.n_regionkey < 3 RETURN n.n_regionkey AS k", "MATCH (n:Nation) WHERE n.n_regionkey > 1 RETURN n.n_regionkey AS k")
_SQLS = ("SELECT n_regionkey AS k FROM nation WHERE n_regionkey<3", "SELECT n_regionkey AS k FROM nation WHERE n_regionkey>1")
for _op in ("UNION ALL", "UNION", "INTERSECT", "EXCEPT", "INTERSECT ALL", "EXCEPT ALL"):
    _add("set_" + _op.lower().replace(" ", "_"), f"{_NAMES[0]} {_op} {_NAMES[1]}", f"{_SQLS[0]} {_op} {_SQLS[1]}")
_add("gql_set_braces", "{MATCH (n@Nation) RETURN n.n_name AS k} UNION DISTINCT {MATCH (r@Region) RETURN r.r_name AS k} ORDER BY k LIMIT 9", "SELECT n_name AS k FROM nation UNION SELECT r_name FROM region ORDER BY k LIMIT 9", dialect="gql")

_add("union_by_name", "MATCH (n:Nation) RETURN n.n_name AS a, n.n_regionkey AS b UNION ALL BY NAME MATCH (r:Region) RETURN r.r_regionkey AS b, r.r_name AS a", "SELECT n_name AS a, n_regionkey AS b FROM nation UNION ALL BY NAME SELECT r_regionkey AS b, r_name AS a FROM region")

# Scalar functions
_add("time_functions", "MATCH (o:Orders) RETURN o.o_orderkey AS o, timestampdiff('mon', localdatetime('1990-01-15'), o.o_orderdate) AS m, timestampdiff(DAY, localdatetime('1996-01-01'), o.o_orderdate) AS d, time(o.o_orderdate) AS t, localdatetime('now') > o.o_orderdate AS past", "SELECT o_orderkey AS o, datesub('month', TIMESTAMP '1990-01-15', CAST(o_orderdate AS TIMESTAMP)) AS m, datesub('day', TIMESTAMP '1996-01-01', CAST(o_orderdate AS TIMESTAMP)) AS d, strftime(o_orderdate, '%H:%M:%S') AS t, true AS past FROM orders")
_add("integer_division", "MATCH (n:Nation) RETURN n.n_nationkey AS n, div(n.n_nationkey, n.n_regionkey) AS d, n.n_nationkey ^ 2 AS p", "SELECT n_nationkey AS n, CASE WHEN n_regionkey=0 THEN NULL ELSE CAST(n_nationkey//n_regionkey AS BIGINT) END AS d, pow(n_nationkey,2) AS p FROM nation")
_add("substr_branches", "MATCH (c:Customer) RETURN c.c_custkey AS c, substr(c.c_name, 3) AS a, substr(c.c_name, 2, 4) AS b, substr(c.c_name, -3) AS d, substr(c.c_name, -5, 2) AS e, substr(c.c_name, 4, -2) AS f, substr(c.c_name, 0, 2) AS g, substring(c.c_name, 1, 3) AS h", "SELECT c_custkey AS c, c_name[3:] AS a, c_name[2:5] AS b, c_name[-3:] AS d, c_name[length(c_name)-4:length(c_name)-3] AS e, c_name[2:3] AS f, c_name[1:1] AS g, c_name[2:4] AS h FROM customer")
_add("text_functions", "MATCH (c:Customer) RETURN c.c_custkey AS c, apoc.text.indexOf(c.c_name, 'm') + 1 AS i, replace(c.c_name, 'Customer', 'X') AS r, trim(BOTH 'C' FROM c.c_name) AS t, c.c_name || '-' || c.c_mktsegment AS j, toUpper(c.c_name) AS u, toLower(c.c_name) AS l, SIZE(c.c_name) AS s, char_length(c.c_custkey) AS n", "SELECT c_custkey AS c, CAST(instr(c_name,'m') AS BIGINT) AS i, replace(c_name,'Customer','X') AS r, trim(c_name,'C') AS t, c_name||'-'||c_mktsegment AS j, upper(c_name) AS u, lower(c_name) AS l, CAST(length(c_name) AS BIGINT) AS s, CAST(length(CAST(c_custkey AS VARCHAR)) AS BIGINT) AS n FROM customer")
_add("gql_text_functions", "MATCH (c@Customer) RETURN c.c_custkey AS c, position('m', c.c_name) + 1 AS i, contains(c.c_name, '9') AS k, cast(c.c_acctbal as int) AS n, regexp_like(c.c_name, '.*1.*') AS r", "SELECT c_custkey AS c, CAST(instr(c_name,'m') AS BIGINT) AS i, contains(c_name,'9') AS k, CAST(trunc(c_acctbal) AS BIGINT) AS n, regexp_full_match(c_name,'.*1.*') AS r FROM customer", dialect="gql")
_add("arithmetic", "MATCH (n:Nation) RETURN n.n_nationkey AS n, n.n_nationkey / 2 AS h, n.n_nationkey / n.n_regionkey AS z, n.n_nationkey % 3 AS m, n.n_nationkey / 2.0 AS f, abs(n.n_regionkey - 3) AS a, n.n_nationkey + n.n_regionkey * 2 - 1 AS s", "SELECT n_nationkey AS n, CAST(n_nationkey//2 AS BIGINT) AS h, CASE WHEN n_regionkey=0 THEN NULL ELSE CAST(n_nationkey//n_regionkey AS BIGINT) END AS z, n_nationkey%3 AS m, n_nationkey/2.0::DOUBLE AS f, abs(n_regionkey-3) AS a, n_nationkey+n_regionkey*2-1 AS s FROM nation")
_add("round_cast", "MATCH (c:Customer) RETURN c.c_custkey AS c, round(c.c_acctbal) AS r, round(c.c_acctbal, 1) AS r1, toInteger(c.c_acctbal) AS i, toString(c.c_nationkey) AS s, toFloat(c.c_name) AS f, toInteger('12') AS t", "SELECT c_custkey AS c, round(c_acctbal) AS r, round(c_acctbal,1) AS r1, CAST(trunc(c_acctbal) AS BIGINT) AS i, CAST(c_nationkey AS VARCHAR) AS s, TRY_CAST(c_name AS DOUBLE) AS f, CAST(12 AS BIGINT) AS t FROM customer")
_add("coercion", "MATCH (n:Nation) WHERE n.n_regionkey = '2' OR n.n_nationkey > '22' RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_regionkey=2 OR n_nationkey>22")
_add("greatest_least", "MATCH (n:Nation) RETURN n.n_name AS n, max(n.n_nationkey, n.n_regionkey * 6) AS a, min(n.n_nationkey, n.n_regionkey * 6) AS b", "SELECT n_name AS n, greatest(n_nationkey,n_regionkey*6) AS a, least(n_nationkey,n_regionkey*6) AS b FROM nation")
_add("dates", "MATCH (o:Orders) WHERE o.o_orderdate >= localdatetime('1996-01-01') AND o.o_orderdate < '1997-01-01' RETURN o.o_orderkey AS o, strftime('%Y-%m', o.o_orderdate) AS m, year(o.o_orderdate) AS y, datediff(o.o_orderdate, localdatetime('1996-01-01')) AS d", "SELECT o_orderkey AS o, strftime(o_orderdate,'%Y-%m') AS m, CAST(year(o_orderdate) AS BIGINT) AS y, date_diff('day', TIMESTAMP '1996-01-01', o_orderdate) AS d FROM orders WHERE o_orderdate>='1996-01-01' AND o_orderdate<'1997-01-01'")
_add("date_trunc", "MATCH (o:Orders) RETURN o.o_orderkey AS o, localdatetime.truncate('month', o.o_orderdate) AS m, date(o.o_orderdate) AS d", "SELECT o_orderkey AS o, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d FROM orders")


def text_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, dialect, mode, _ = TEXTS[name]
    return lambda spark, sf_dir: Engine(spark, star_graph(spark, sf_dir), dialect, mode).query(text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_query("flagship")(spark, sf_dir)


# Queries through the DataFrame interfaces
def _tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Columns:
    """Names of a relational scope: a column is its alias and name."""

    @staticmethod
    def prop(var: str, name: str):
        return F.col(f"{var}.{name}"), None

    @staticmethod
    def var(name: str):
        return F.col(name)

    value_kind = staticmethod(lambda name: None)


def _joined(side: str, on, a: str, b: str, *cols: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _tables(spark, sf_dir)
        out = join_frames(t(a).alias("a"), t(b).alias("b"), on, side, Compiler(_Columns()))
        return out.selectExpr(*cols)

    return run


def _p(x: str) -> ir.Prop:
    return ir.Prop(*x.split("."))


def _eq(x: str, y: str) -> ir.Bin:
    return ir.Bin("=", _p(x), _p(y))


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _frame(name: str, run, sql: str) -> None:
    FRAMES[name] = (run, sql)


_C, _N, _S, _O = "customer", "nation", "supplier", "orders"
_frame("join_inner", _joined("inner", _eq("a.c_nationkey", "b.n_nationkey"), _C, _N, "c_custkey AS c", "n_name AS n"), "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey=n_nationkey")
_frame("join_left", _joined("left", ir.Bin("and", _eq("a.n_nationkey", "b.s_nationkey"), ir.Bin("<", _p("b.s_acctbal"), ir.Lit(0))), _N, _S, "n_name AS n", "s_suppkey AS s"), "SELECT n_name AS n, s_suppkey AS s FROM nation LEFT JOIN supplier ON n_nationkey=s_nationkey AND s_acctbal<0")
_frame("join_right", _joined("right", ir.Bin("and", _eq("a.s_nationkey", "b.n_nationkey"), ir.Bin("<", _p("a.s_acctbal"), ir.Lit(0))), _S, _N, "n_name AS n", "s_suppkey AS s"), "SELECT n_name AS n, s_suppkey AS s FROM supplier RIGHT JOIN nation ON n_nationkey=s_nationkey AND s_acctbal<0")
_frame("join_full", _joined("full", ir.Bin("and", _eq("a.s_nationkey", "b.n_nationkey"), ir.Bin("<", _p("a.s_acctbal"), ir.Lit(0))), _S, _N, "n_name AS n", "s_suppkey AS s"), "SELECT n_name AS n, s_suppkey AS s FROM supplier FULL JOIN nation ON n_nationkey=s_nationkey AND s_acctbal<0")
_frame("join_semi", _joined("semi", ir.Bin("and", _eq("a.c_custkey", "b.o_custkey"), ir.Bin(">", _p("b.o_totalprice"), ir.Lit(400000))), _C, _O, "c_custkey AS c"), "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>400000)")
_frame("join_anti", _joined("anti", ir.Bin("and", _eq("a.c_custkey", "b.o_custkey"), ir.Bin(">", _p("b.o_totalprice"), ir.Lit(400000))), _C, _O, "c_custkey AS c"), "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>400000)")
_frame("join_cross", _joined("cross", None, "region", _N, "r_name AS r", "n_name AS n"), "SELECT r_name AS r, n_name AS n FROM region, nation")
_frame("join_lower", _joined("inner", ir.Bin("=", ir.Call("lower", (_p("a.n_name"),)), ir.Call("lower", (_p("b.n_name"),))), _N, _N, "a.n_nationkey AS x", "b.n_nationkey AS y"), "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON lower(a.n_name)=lower(b.n_name)")
_frame("join_neq", _joined("inner", ir.Bin("<>", _p("a.n_regionkey"), _p("b.r_regionkey")), _N, "region", "n_name AS n", "r_name AS r"), "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey<>r_regionkey")
_frame("join_theta", _joined("inner", ir.Bin("<", _p("a.n_nationkey"), _p("b.r_regionkey")), _N, "region", "n_name AS n", "r_name AS r"), "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_nationkey<r_regionkey")
_WITHIN = ir.Between(_p("a.c_acctbal"), _p("b.s_acctbal"), ir.Bin("+", _p("b.s_acctbal"), ir.Lit(50)))
_LESS = ir.Bin("<", _p("a.s_acctbal"), _p("b.s_acctbal"))
_NEAR = ir.Bin("and", ir.Bin(">", _p("a.c_acctbal"), _p("b.s_acctbal")), ir.Bin("<", _p("a.c_acctbal"), ir.Bin("+", _p("b.s_acctbal"), ir.Bin("*", ir.Lit(10), _p("b.s_nationkey")))))
_frame("join_between", _joined("inner", _WITHIN, _C, _S, "c_custkey AS c", "s_suppkey AS s"), "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal AND s_acctbal + 50")
_frame("join_less_than_pairs", _joined("inner", _LESS, _S, _S, "a.s_suppkey AS x", "b.s_suppkey AS y"), "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal")
for _kind, _words in (("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    _frame(f"join_near_{_kind}", _joined(_kind, _NEAR, _C, _S, "c_custkey AS c", "s_suppkey AS s"), f"SELECT c_custkey AS c, s_suppkey AS s FROM customer {_words} supplier ON c_acctbal > s_acctbal AND c_acctbal < s_acctbal + 10 * s_nationkey")
    _frame(f"join_or_{_kind}_side", _joined(_kind, ir.Bin("or", _eq("a.s_nationkey", "b.c_custkey"), _eq("a.s_suppkey", "b.c_nationkey")), _S, _C, "s_suppkey AS s", "c_custkey AS c"), f"SELECT s_suppkey AS s, c_custkey AS c FROM supplier {_words} customer ON s_nationkey=c_custkey OR s_suppkey=c_nationkey")
for _kind, _words in (("semi", "EXISTS"), ("anti", "NOT EXISTS")):
    _frame(f"join_near_{_kind}", _joined(_kind, ir.transform(_NEAR, lambda x: ir.Prop({"a": "b", "b": "a"}[x.var], x.name) if isinstance(x, ir.Prop) else x), _S, _C, "s_suppkey AS s"), f"SELECT s_suppkey AS s FROM supplier WHERE {_words} (SELECT 1 FROM customer WHERE c_acctbal > s_acctbal AND c_acctbal < s_acctbal + 10 * s_nationkey)")
    _frame(f"join_or_{_kind}", _joined(_kind, ir.Bin("or", _eq("a.c_custkey", "b.s_nationkey"), _eq("a.c_custkey", "b.s_suppkey")), _C, _S, "c_custkey AS c"), f"SELECT c_custkey AS c FROM customer WHERE {_words} (SELECT 1 FROM supplier WHERE c_custkey=s_nationkey OR c_custkey=s_suppkey)")
_frame("join_or", _joined("inner", ir.Bin("or", _eq("a.c_nationkey", "b.s_nationkey"), _eq("a.c_custkey", "b.s_suppkey")), _C, _S, "c_custkey AS c", "s_suppkey AS s"), "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey=s_nationkey OR c_custkey=s_suppkey")
_frame("join_composite", _joined("inner", ir.Bin("and", _eq("a.l_partkey", "b.p_partkey"), _eq("a.l_linenumber", "b.p_size")), "lineitem", "part", "l_orderkey AS o", "p_partkey AS p"), "SELECT l_orderkey AS o, p_partkey AS p FROM lineitem JOIN part ON l_partkey=p_partkey AND l_linenumber=p_size")
_frame("join_bare_column", _joined("inner", _p("b.r_regionkey"), _N, "region", "n_name AS n", "r_name AS r"), "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey<>0")
_frame("join_never", _joined("left", ir.Bin("=", _eq("a.n_regionkey", "b.r_regionkey"), _p("a.n_nationkey")), _N, "region", "n_name AS n", "r_name AS r"), "SELECT n_name AS n, CAST(NULL AS VARCHAR) AS r FROM nation")


def _pattern_of_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer JOIN orders LEFT JOIN big suppliers' nation, rewritten to MATCH clauses."""
    edges = [Edge("PLACED", "Customer", "Orders", ("c_custkey",), ("o_custkey",)), Edge("CUSTOMER_IN", "Customer", "Nation", ("c_nationkey",), ("n_nationkey",))]
    on = _eq("c.c_custkey", "o.o_custkey")
    far = ir.Bin("and", _eq("c.c_nationkey", "n.n_nationkey"), ir.Bin("=", _p("n.n_regionkey"), ir.Lit(1)))
    clauses = pattern(Table("Customer", "c"), [Join(Table("Orders", "o"), on), Join(Table("Nation", "n"), far, "left")], edges)
    back = ir.Return((ir.Item(_p("o.o_orderkey"), "o"), ir.Item(_p("n.n_name"), "n")))
    return Engine(spark, star_graph(spark, sf_dir)).run(ir.Single((*clauses, back)))


_MANY = [Edge("CONTAINS", "Orders", "Part", ("o_orderkey",), ("p_partkey",), "lineitem", ("l_orderkey",), ("l_partkey",))]
_KEYS = [Edge("PLACED", "Customer", "Orders", ("c_custkey",), ("o_custkey",)), Edge("SUPPLIER_IN", "Supplier", "Nation", ("s_nationkey",), ("n_nationkey",))]


def _query_of_joins(first: Table, joins: list[Join], items: dict[str, str], where=None):
    """Joins as a graph query."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        back = tuple(ir.Item(_p(x), name) for name, x in items.items())
        return Engine(spark, star_graph(spark, sf_dir)).run(join_query(first, joins, _MANY + _KEYS, back, where=where))

    return run


_BIG = ir.Bin("and", _eq("c.c_custkey", "o.o_custkey"), ir.Bin(">", _p("o.o_totalprice"), ir.Lit(400000)))
_RICH = ir.Bin("and", _eq("s.s_nationkey", "n.n_nationkey"), ir.Bin(">", _p("s.s_acctbal"), ir.Lit(8000)))
_frame("pattern_semi", _query_of_joins(Table("Customer", "c"), [Join(Table("Orders", "o"), _BIG, "semi")], {"c": "c.c_custkey"}), "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>400000)")
_frame("pattern_anti", _query_of_joins(Table("Customer", "c"), [Join(Table("Orders", "o"), _BIG, "anti")], {"c": "c.c_custkey"}), "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>400000)")
_frame("pattern_full", _query_of_joins(Table("Supplier", "s"), [Join(Table("Nation", "n"), _RICH, "full")], {"s": "s.s_suppkey", "n": "n.n_name"}), "SELECT s_suppkey AS s, n_name AS n FROM supplier FULL JOIN nation ON s_nationkey=n_nationkey AND s_acctbal>8000")
_frame("pattern_from_only", _query_of_joins(Table("Region", "r"), [], {"r": "r.r_name"}), "SELECT r_name AS r FROM region")
_frame("join_via_table", _query_of_joins(Table("Orders", "o"), [Join(Table("lineitem", "l"), _eq("o.o_orderkey", "l.l_orderkey")), Join(Table("Part", "p"), _eq("p.p_partkey", "l.l_partkey"))], {"o": "o.o_orderkey", "p": "p.p_partkey", "q": "l.l_quantity"}, ir.Bin(">", _p("p.p_size"), ir.Lit(45))), "SELECT o_orderkey AS o, p_partkey AS p, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey WHERE p_size>45")


def _using(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    a, b = t("documents").select("doc_id", "lang"), t("labels").select("doc_id", "quality")
    return join_frames(a, b, None, "left", using=("doc_id",), hint="merge")


_frame("join_using", _using, "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
_frame("join_or_left", _joined("left", ir.Bin("or", ir.Bin("or", _eq("a.s_nationkey", "b.c_custkey"), _eq("a.s_suppkey", "b.c_custkey")), _eq("a.s_suppkey", "b.c_nationkey")), _S, _C, "s_suppkey AS s", "c_custkey AS c"), "SELECT s_suppkey AS s, c_custkey AS c FROM supplier LEFT JOIN customer ON s_nationkey=c_custkey OR s_suppkey=c_custkey OR s_suppkey=c_nationkey")
_frame("join_to_pattern", _pattern_of_joins, "SELECT o_orderkey AS o, n_name AS n FROM customer JOIN orders ON o_custkey=c_custkey LEFT JOIN nation ON n_nationkey=c_nationkey AND n_regionkey=1")


def _fk(policy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _tables(spark, sf_dir)
        return fk_edges(t("orders"), t("customer"), ForeignKey("orders", "customer", ("o_custkey",), ("c_custkey",)), "o_orderkey", "c_custkey", policy).select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))

    return run


_frame("fk_edges_all_pairs", _fk("all_pairs"), "SELECT o_orderkey AS src, c_custkey AS dst FROM orders JOIN customer ON o_custkey=c_custkey")
_frame("fk_edges_first_match", _fk("first_match"), "SELECT min(o_orderkey) AS src, o_custkey AS dst FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 2")


def _jt(properties: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _tables(spark, sf_dir)
        line = t("lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
        a = (t("part"), ForeignKey("lineitem", "part", ("l_partkey",), ("p_partkey",)), "p_partkey")
        b = (t("supplier"), ForeignKey("lineitem", "supplier", ("l_suppkey",), ("s_suppkey",)), "s_suppkey")
        return jt_edges(line, a, b, properties).withColumnRenamed("_src", "src").withColumnRenamed("_dst", "dst")

    return run


_frame("jt_edges_all", _jt("all"), "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_partkey, l_suppkey, l_linenumber FROM lineitem")
_frame("jt_edges_non_key", _jt("non_key"), "SELECT l_partkey AS src, l_suppkey AS dst, l_linenumber FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem)")
_frame("topk_per_key", lambda spark, d: top_k(_tables(spark, d)("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10).select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), "rank"), "SELECT o_custkey AS c, o_orderkey AS o, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank<=10")


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _tables(spark, sf_dir)("embeddings")
    return similarity_top_k(e, e, "vec_id", "embedding", 10).select("from_id", "to_id", "rank", F.round("score", 6).alias("score"))


_frame("cosine_topk", _similar, "WITH s AS (SELECT q.vec_id AS from_id, e.vec_id AS to_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS x FROM embeddings q JOIN embeddings e ON e.vec_id<>q.vec_id) SELECT from_id, to_id, CAST(row_number() OVER (PARTITION BY from_id ORDER BY x DESC, to_id) AS INTEGER) AS rank, round(x,6) AS score FROM s QUALIFY rank<=10")
_frame("degrees", lambda spark, d: degrees(_tables(spark, d)("orders"), "o_custkey", "o_orderkey")[0].select(F.col("o_custkey").alias("c"), "degree"), "SELECT o_custkey AS c, count(*) AS degree FROM orders GROUP BY 1")
_frame("degree_cap_violations", lambda spark, d: cardinality_violations(_tables(spark, d)("orders"), "o_custkey", "o_orderkey", 15, 1), "SELECT 'source' AS side, CAST(o_custkey AS VARCHAR) AS id, count(*) AS degree FROM orders GROUP BY o_custkey HAVING count(*)>15")
_frame("unique_violations", lambda spark, d: unique_violations(_tables(spark, d)("part"), "p_name"), "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*)>1")
_frame("referential_check", lambda spark, d: missing_ends(_tables(spark, d)("documents"), "doc_id", _tables(spark, d)("labels"), "doc_id").select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_frame("constraint_violations", lambda spark, d: constraint_violations(_tables(spark, d)("customer"), "c_custkey", "solvent", "c_acctbal >= 0"), "SELECT 'solvent' AS constraint, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal<0")
_frame("distinct_on", lambda spark, d: distinct_on(_tables(spark, d)("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey"), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
_frame("cube", lambda spark, d: _tables(spark, d)("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("k")), "SELECT o_orderstatus, o_orderpriority, count(*) AS k FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)")
_frame("rollup", lambda spark, d: _tables(spark, d)("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("k")), "SELECT o_orderstatus, o_orderpriority, count(*) AS k FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")
_frame("grouping_sets", lambda spark, d: _tables(spark, d)("orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("k")), "SELECT o_orderstatus, o_orderpriority, count(*) AS k FROM orders GROUP BY GROUPING SETS ((o_orderstatus),(o_orderpriority),())")
_frame("event_windows", lambda spark, d: windowed_counts(_tables(spark, d)("events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2")
_frame("event_sessions", lambda spark, d: sessions(_tables(spark, d)("events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"), "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g")


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query built by calls."""
    c, n = table("Customer", "c"), table("Nation", "n")
    q = select(col("n.n_name").as_("nation"), func("count", star()).as_("k")).from_(c).join(n, col("c.c_nationkey") == col("n.n_nationkey")).where(col("c.c_acctbal") > 0)
    q = q.group_by(col("n.n_name")).having(func("max", col("c.c_acctbal")) > 9000).order_by(col("k").desc(), col("nation")).limit(10)
    return q.frame(Engine(spark, star_graph(spark, sf_dir)), [Edge("CUSTOMER_IN", "Customer", "Nation", ("c_nationkey",), ("n_nationkey",))])


_frame("built_query", _built, "SELECT n_name AS nation, count(*) AS k FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE c_acctbal>0 GROUP BY 1 HAVING max(c_acctbal)>9000 ORDER BY 2 DESC, 1 LIMIT 10")


def _built_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = select(col("n.n_regionkey").as_("k")).from_(table("Nation", "n"))
    q = names.where(col("n.n_regionkey") < 3).union(names.where(col("n.n_regionkey") > 1)).except_(names.where(col("n.n_regionkey") == 4)).order_by("k")
    return q.frame(Engine(spark, star_graph(spark, sf_dir)))


_frame("built_union", _built_union, "SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_regionkey<>4")
_frame("label_frequency", lambda spark, d: label_frequency(_tables(spark, d)("lineitem"), "l_returnflag"), "SELECT l_returnflag, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS INTEGER) AS rank FROM lineitem GROUP BY 1")
_frame("unique_repair", lambda spark, d: unique_repaired(_tables(spark, d)("part").select("p_partkey", "p_name"), "p_name", ["p_partkey"], "again_"), "SELECT p_partkey, CASE WHEN row_number() OVER w = 1 THEN p_name ELSE 'again_' || p_name || '_' || row_number() OVER w END AS p_name FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)")
def _placement(df: DataFrame, key: str) -> DataFrame:
    """How many rows of ``df`` stand below an earlier one of their partition, and how many keys lie in several."""
    placed = df.select(F.col(key).alias("k"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("k").over(Window.partitionBy("part").orderBy("at"))
    rows = placed.withColumn("below", (before > F.col("k")).cast("long"))
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("below", F.lit(0))).alias("below"), F.count_distinct("part").alias("parts"))
    return per.agg(F.sum("n").alias("n"), F.sum("below").alias("below"), F.sum((F.col("parts") > 1).cast("long")).alias("parted"))


_frame("sort_by", lambda spark, d: _placement(sort_by(_tables(spark, d)("orders").repartition(3), "o_totalprice"), "o_totalprice").select("n", "below"), "SELECT count(*) AS n, 0::BIGINT AS below FROM orders")
def _dealt_rows(df: DataFrame, key: str) -> DataFrame:
    """Every row of ``df``, and whether rows of its key stand in another partition as well."""
    of_key = Window.partitionBy(key)
    return df.withColumn("_part", F.spark_partition_id()).withColumn("parted", F.min("_part").over(of_key) != F.max("_part").over(of_key)).drop("_part")


_frame("distribute_by", lambda spark, d: _dealt_rows(distribute_by(_tables(spark, d)("orders"), "o_custkey"), "o_custkey"), "SELECT *, false AS parted FROM orders")
_frame("cluster_by", lambda spark, d: _placement(cluster_by(_tables(spark, d)("orders"), "o_custkey"), "o_custkey"), "SELECT count(*) AS n, 0::BIGINT AS below, 0::BIGINT AS parted FROM orders")
_frame("pivot", lambda spark, d: pivoted(_tables(spark, d)("orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1))), "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus='F'),0) AS F, nullif(count(*) FILTER (o_orderstatus='O'),0) AS O, nullif(count(*) FILTER (o_orderstatus='P'),0) AS P FROM orders GROUP BY 1")
_frame("unpivot", lambda spark, d: unpivoted(_tables(spark, d)("nation").select("n_name", "n_nationkey", "n_regionkey"), ["n_name"], ["n_nationkey", "n_regionkey"], "what", "key"), "SELECT n_name, 'n_nationkey' AS what, n_nationkey AS key FROM nation UNION ALL SELECT n_name, 'n_regionkey', n_regionkey FROM nation")


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts reached from the first ones by doubling keys."""
    t = _tables(spark, sf_dir)("part")
    edges = t.select(F.col("p_partkey").alias("_src"), (F.col("p_partkey") * 2 + 1).alias("_dst"))
    return closure(edges, t.where("p_partkey IN (1, 2)").select(F.col("p_partkey").alias("node")), 6)


def _analyzed(text: str):
    """A query of a graph whose counts and degrees order the joins."""
    return lambda spark, sf_dir: Engine(spark, star_graph(spark, sf_dir)).analyze().query(text)


_frame("triangle_hub", _analyzed("MATCH (o:Orders)-[:CONTAINS]->(p:Part)<-[:SUPPLIES]-(s:Supplier)<-[:FULFILLED_BY]-(o) RETURN s.s_name AS s, p.p_brand AS b, count(*) AS n"), "SELECT s_name AS s, p_brand AS b, count(*) AS n FROM lineitem x JOIN lineitem y ON x.l_partkey=y.l_partkey JOIN lineitem z ON z.l_orderkey=x.l_orderkey AND z.l_suppkey=y.l_suppkey JOIN supplier ON s_suppkey=y.l_suppkey JOIN part ON p_partkey=x.l_partkey GROUP BY 1, 2")
_frame("planned_path", _analyzed("MATCH (p:Part)<-[x:CONTAINS]-(o:Orders)<-[:PLACED]-(c:Customer)-[:CUSTOMER_IN]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE x.l_quantity > 45 RETURN r.r_name AS r, p.p_brand AS b, count(*) AS k"), "SELECT r_name AS r, p_brand AS b, count(*) AS k FROM lineitem JOIN part ON p_partkey=l_partkey JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey WHERE l_quantity > 45 GROUP BY 1, 2")
_frame("collect_chunked", lambda spark, d: collected(_tables(spark, d)("lineitem"), ["l_returnflag"], [F.asc("l_orderkey"), F.desc("l_extendedprice")], F.col("l_orderkey"), 1000).select("l_returnflag", "chunk", "n", F.array_join(F.col("values").cast("array<string>"), ",").alias("orders")), "WITH p AS (SELECT l_returnflag, l_orderkey, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_extendedprice DESC) - 1) AS i FROM lineitem) SELECT l_returnflag, i // 1000 AS chunk, count(*) AS n, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY i) AS orders FROM p GROUP BY 1, 2")
_frame("recursive", _reached, "WITH RECURSIVE r(start, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey IN (1,2) UNION ALL SELECT start, p_partkey*2+1, depth+1 FROM r JOIN part ON p_partkey=node WHERE depth<6) SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2")


def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _tables(spark, sf_dir)("embeddings").where("vec_id < 12")
    return similarity_matrix(e, e, "vec_id", "embedding").select("from_id", "to_id", F.round("score", 6).alias("score"))


_frame("cosine_matrix", _cosines, "SELECT a.vec_id AS from_id, b.vec_id AS to_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id WHERE a.vec_id<12 AND b.vec_id<12")


def _likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric similarity and attribute text of nations' pairs in a region, and a cosine of columns."""
    n = _tables(spark, sf_dir)("nation")
    a, b = n.select([F.col(c).alias(f"a_{c}") for c in n.columns]), n.select([F.col(c).alias(f"b_{c}") for c in n.columns])
    both = a.join(b, (F.col("a_n_regionkey") == F.col("b_n_regionkey")) & (F.col("a_n_nationkey") < F.col("b_n_nationkey")))
    score = numeric_similarity([(F.col("a_n_nationkey"), F.col("b_n_nationkey"), 24.0), (F.col("a_n_regionkey"), F.col("b_n_regionkey"), 4.0)])
    angle = cosine(F.array("a_n_nationkey", F.lit(1)), F.array("b_n_nationkey", F.lit(2)))
    return both.select(attribute_string(["a_n_name", "a_n_regionkey"]).alias("a"), F.col("b_n_name").alias("b"), F.round(score, 6).alias("score"), F.round(angle, 6).alias("angle"))


_frame("likeness", _likeness, "SELECT '{a_n_name:' || a.n_name || ',a_n_regionkey:' || a.n_regionkey || '}' AS a, b.n_name AS b, round(1 - (abs(a.n_nationkey-b.n_nationkey)/24.0)/2, 6) AS score, round((a.n_nationkey * b.n_nationkey + 2) / (sqrt(a.n_nationkey * a.n_nationkey + 1.0) * sqrt(b.n_nationkey * b.n_nationkey + 4.0)), 6) AS angle FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_nationkey<b.n_nationkey")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns read by their declared types; '' and 'NULL' are null."""
    o = _tables(spark, sf_dir)("orders").select("o_orderkey", *[F.col(c).cast("string").alias(c) for c in ("o_orderdate", "o_totalprice", "o_custkey")])
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("NULL")).when(F.col("o_orderkey") % 11 == 0, F.lit("")).otherwise(F.col("o_custkey"))
    return o.select("o_orderkey", coerced(F.col("o_orderdate"), declared_type("DATETIME")).alias("at"), coerced(F.col("o_totalprice"), declared_type("REAL")).alias("price"), coerced(text, declared_type("INTEGER")).alias("customer"))


_frame("typed_columns", _typed, "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS at, o_totalprice AS price, CASE WHEN o_orderkey%7=0 OR o_orderkey%11=0 THEN NULL ELSE o_custkey END AS customer FROM orders")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the event stream, all that is there taken by a streaming query."""
    out = streamed(read_events(spark, sf_dir), windowed_counts, f"{checkpoint_folder(spark)}/streams")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


_frame("event_stream", _event_stream, "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2")


def _verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of query texts and whether their results are the same."""
    e = Engine(spark, star_graph(spark, sf_dir))
    pairs = [
        ("swapped columns", "MATCH (n:Nation) RETURN n.n_name AS a, n.n_regionkey AS b", "MATCH (n:Nation) RETURN n.n_regionkey AS x, n.n_name AS y"),
        ("other rows", "MATCH (n:Nation) RETURN n.n_name AS a", "MATCH (n:Nation) WHERE n.n_nationkey > 0 RETURN n.n_name AS a"),
        ("other order", "MATCH (r:Region) RETURN r.r_name AS a ORDER BY a DESC", "MATCH (r:Region) RETURN r.r_name AS a ORDER BY a"),
        ("bag", "MATCH (n:Nation) RETURN n.n_regionkey AS a", "MATCH (r:Region)<-[:IN_REGION]-(n) RETURN r.r_regionkey AS b"),
    ]
    rows = [(name, execution_accuracy(e, a, b).score) for name, a, b in pairs]
    return spark.createDataFrame(rows, "pair string, score double")


_frame("res_eq_pairs", _verdict, "SELECT * FROM (VALUES ('swapped columns', 1.0::DOUBLE), ('other rows', 0.0), ('other order', 0.0), ('bag', 1.0)) t(pair, score)")
_frame("stats_rollup", lambda spark, d: rollup(_tables(spark, d)("labels").withColumn("is_success", F.col("quality")), ["toxic"]), "SELECT toxic, count(*) AS total, CAST(sum(quality) AS BIGINT) AS passed, round(avg(quality),6) AS rate FROM labels GROUP BY 1")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: text_query(n) for n in TEXTS} | {n: run for n, (run, _) in FRAMES.items()}
ORACLES: dict[str, str] = {n: sql for n, (_, _, _, sql) in TEXTS.items()} | {n: sql for n, (_, sql) in FRAMES.items()}
