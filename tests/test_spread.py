"""How rows are dealt before much is made of them, and joins with tables of a few rules."""

from loomgraph.functions import nesting, semantics
from loomgraph.operators import rulepacks
from loomgraph.plans import structure
from loomgraph.session import spread
from loomgraph.sources.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_over_all_tasks(spark):
    assert spread(spark.range(100), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_go_roots_of_a_file_meet_where_the_file_is(spark):
    files = spark.createDataFrame([("r", "a.go", "go", "func main() {")], "repo_id string, path string, language string, content string")
    assert plan(semantics.go_roots(files)).count("Exchange") == 1


def test_packs_are_broadcast(spark):
    cands = spark.createDataFrame([("c", "p", "k", 1.0)], "candidate string, pack string, correlation_key string, confidence double")
    atoms = spark.createDataFrame([("c", "a", *["x"] * 5)], ["candidate", "atom", *rulepacks.ATOM_FIELDS])
    found = plan(rulepacks.match_counts(cands, atoms, rulepacks.first_party(spark)))
    assert "BroadcastHashJoin" in found
    assert plan(rulepacks.evaluate(cands, atoms, rulepacks.first_party(spark))).count("BroadcastHashJoin") >= 5


def test_nesting_reads_files_once_and_deals_them_once(spark):
    files = spark.createDataFrame([("r", "a.go", "go", "func a() {\n}\n")], "repo_id string, path string, language string, content string")
    found = plan(nesting.containment(nesting.spans(files)))
    assert found.count("Exchange") == 1 and found.count("Scan ") == 1


def test_parts_are_dealt_before_their_files_are_written(spark, data):
    for query in (structure.definition_spans, structure.definition_containment, structure.nesting_profile):
        found = plan(query(Tables(spark, data)))
        assert found.count("REPARTITION_BY_NUM") == 1 and found.count("FileScan") == 1
        assert "class C$" not in found[found.index("REPARTITION_BY_NUM") :]


def test_lines_of_files_are_sorted_in_more_tasks_than_a_shuffle_has(spark, data):
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {nesting.TASKS * most}), REPARTITION_BY_NUM" in plan(structure.definition_containment(Tables(spark, data))) and nesting.TASKS > 1
