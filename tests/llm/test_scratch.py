"""What a job writes on its way is deleted with it, and with no other thread's job."""

import threading

from contestlab.llm.common import materialize, scratch


def test_threads_delete_their_own(spark):
    here, there = threading.Event(), threading.Event()
    found = {}

    def other():
        with scratch():
            found["theirs"] = materialize(spark.range(3), "theirs")
            here.set()
            there.wait(60)
            found["rows"] = found["theirs"].count()  # still there after this thread's job has ended

    t = threading.Thread(target=other)
    t.start()
    here.wait(60)
    with scratch():
        mine = materialize(spark.range(2), "mine")
        with scratch():
            materialize(spark.range(1), "inner")
        assert mine.count() == 2
    there.set()
    t.join(60)
    assert found["rows"] == 3
    path = spark._jvm.org.apache.hadoop.fs.Path
    for df in (mine, found["theirs"]):
        assert not path(df._folder).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(df._folder))
