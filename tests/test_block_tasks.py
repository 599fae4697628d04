from folioflow.sources.ranges import SLOT_TASKS, TASK_BYTES, blocks_of


def test_tasks_grow_with_bytes_and_not_with_blocks(spark):
    slots = spark.sparkContext.defaultParallelism
    small = spark.createDataFrame([(f"f{i}", 1000) for i in range(900)], "path STRING, length BIGINT")
    blocks, tasks = blocks_of(small, 100)
    assert tasks == SLOT_TASKS * slots == blocks.rdd.getNumPartitions()
    assert blocks.count() == 9000
    large = spark.createDataFrame([("f", 200 * TASK_BYTES)], "path STRING, length BIGINT")
    assert blocks_of(large, 1 << 20)[1] == 200
    assert blocks_of(large, 100 * TASK_BYTES)[1] == 2
