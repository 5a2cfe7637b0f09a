"""What running a query cost, by Spark's own figures."""


def stages(spark, run):
    """Figures of the stages that ``run`` caused."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    listed = lambda: {s.stageId(): s for s in (lambda all_of: [all_of.apply(k) for k in range(all_of.size())])(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None))}
    before = set(listed())
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return [s for k, s in listed().items() if k not in before]


def shuffled(spark, df):
    """Rows that shuffles wrote while ``df`` ran."""
    return sum(s.shuffleWriteRecords() for s in stages(spark, df.write.format("noop").mode("overwrite").save))
