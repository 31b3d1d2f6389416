"""Where intermediate tables go: a workspace in the shared folder that the cluster names."""

import atexit
import tempfile
import uuid

from pyspark import StorageLevel

_open = {}


class Workspace:
    """A folder for the tables that jobs keep in between, deleted on ``close``.

    It lies below ``folder``, or below ``spark.checkpoint.dir`` (or the folder set on the context).  Only a
    session on one machine without any of these gets a temporary folder; on a cluster that would not
    be shared, so there it is an error.  Nothing is created before the first use.
    """

    def __init__(self, spark, folder=None):
        self.spark = spark
        self.folder = folder
        self._path = None
        self._cached = []

    @property
    def path(self):
        if self._path is None:
            context = self.spark.sparkContext
            base = self.folder or self.spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
            if not base:
                if not context.master.startswith("local"):
                    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share, or name one")
                base = tempfile.mkdtemp(prefix="opinionloom-")
                context.setCheckpointDir(base)
            self._path = f"{base.rstrip('/')}/workspace-{uuid.uuid4().hex}"
        return self._path

    def new_folder(self, purpose):
        """A new path for one purpose."""
        return f"{self.path}/{purpose}-{uuid.uuid4().hex}"

    def kept(self, rows, purpose="table", **options):
        """The rows, computed now and written as a Parquet table, with options of Spark's writer.

        Cuts the lineage like a checkpoint, outlives lost executors, and later reads take only the
        columns they need.
        """
        path = self.new_folder(purpose)
        rows.write.options(**options).parquet(path)
        return self.spark.read.parquet(path)

    def cached(self, rows):
        """The rows, stored on the executors' disks when they are first computed; no job runs before.

        What a lost executor held is computed again.
        """
        stored = rows.persist(StorageLevel.DISK_ONLY)
        self._cached.append(stored)
        return stored

    def close(self):
        """Forget the stored rows and delete the folder; tables kept in it cannot be read any more."""
        for rows in self._cached:
            rows.unpersist()
        self._cached = []
        if self._path is not None:
            delete_path(self.spark, self._path)
            self._path = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def workspace(spark):
    """The workspace of the application, closed when Python ends."""
    key = spark.sparkContext.applicationId
    if key not in _open:
        _open[key] = Workspace(spark)
    return _open[key]


@atexit.register
def _close_all():
    for opened in _open.values():
        if opened.spark.sparkContext._jsc is not None and opened.spark.sparkContext._jsc.sc().isStopped() is False:
            opened.close()


def shared_folder(spark, purpose):
    """A new path for one purpose in the workspace of the application."""
    return workspace(spark).new_folder(purpose)


def kept(rows, purpose="table"):
    """The rows, written now as a table in the workspace of the application."""
    return workspace(rows.sparkSession).kept(rows, purpose)


def cached(rows):
    """The rows, stored at their first use for the application."""
    return workspace(rows.sparkSession).cached(rows)


def file_system(spark, path):
    """The file system that a path names, and the path for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_path(spark, path):
    system, target = file_system(spark, path)
    return system.delete(target, True)
