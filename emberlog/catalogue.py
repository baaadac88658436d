"""Fixed values of the log format and the catalogue of known failure phrases.

Everything in this module is data that decides results, so it is stated as plain text.
"""

# --- fixed values: log format -------------------------------------------------------------
# A header line opens a record. It starts with one of two date shapes; nothing else is tested.
HEADER = r"(?:[0-9]{2}/[0-9]{2}/[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2})"

# Every line of a joined record is followed by this separator.
SEPARATOR = " \t "

# Levels that have a behaviour. Any other third token of a header is an unknown level.
LEVELS = ("ERROR", "WARN", "INFO")

# An INFO record is kept only if its joined text contains this phrase.
ROOT_CAUSE = "Caused by:"

# Above this many characters the keyword payload is withheld and the flag is set.
MAX_KEYWORD_CHARS = 135_000_000

# Characters that separate tokens in a header line; the second class is the part below 128.
WHITESPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
ASCII_WHITESPACE = r"\s\x1C-\x1F"

# --- fixed values: phrases looked for in ERROR records ------------------------------------
ERROR_PHRASES = (
    "ERROR TaskSetManager",
    "Job aborted due to stage failure",
    "ERROR Executor",
    "ERROR ApplicationMaster",
    "Broken pipejava.io.IOException",
    "Executor self-exiting due to : Driver",
    "ERROR TransportResponseHandler",
    "ERROR TransportClient",
    "ERROR RetryingBlockFetcher: Exception while beginning fetch",
    "ERROR Utils",
    "ERROR SparkHadoopWriter: Aborting job",
    "OneForOneBlockFetcher: Failed while starting block fetchesjava.io.IOException",
    "ERROR RpcOutboxMessage",
    "ERROR SparkContext: Error initializing SparkContext",
    "java.nio.file.AccessDeniedException",
)

# --- fixed values: phrases looked for in WARN records -------------------------------------
WARN_PHRASES = (
    "exception org.apache.spark.TaskKilledException",
    "failed due to exception java.lang.IllegalStateException",
    "could not be removed as it was not found on disk or in memory",
    "OneWayOutboxMessage: Failed to send one-way RPC",
    "WARN NettyRpcEnv: Ignored failure: java.io.IOException: Failed to send RPC",
    "Failed to fetch remote block",
    "Exception in connection",
    "WARN YarnAllocator: Container killed by YARN for exceeding memory limits",
    "failed due to exception org.apache.spark.SparkException: No port number",
    "NioEventLoop: Selector.select() returned prematurely",
    "exception org.apache.spark.SparkException: Exception thrown in awaitResult",
    "WARN YarnAllocator: Container from a bad node",
    "Issue communicating with driver in heartbeaterorg.apache.spark.SparkException",
    "WARN SparkConf: spark.master yarn-cluster is deprecated in Spark 2.0+",
    "Unable to eagerly init filesystem s3://does/not/exist",
    "SparkConf: The configuration key 'spark.yarn.executor.memoryOverhead' has been deprecated",
    "WARN Executor: Issue communicating with driver in heartbeater",
    "WARN TaskSetManager",
)

CATALOGUE = {"ERROR": ERROR_PHRASES, "WARN": WARN_PHRASES}
