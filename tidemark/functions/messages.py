"""Message bytes to JSON text and to the parts of it that are read, in one parse."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name of the field that closes what was read.
END = "~"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parsed(text: Column, fields: T.StructType) -> Column:
    """Everything that is to be known of a message: an array of its typed fields and an end mark.

    Spark's parser stops after the first value, so a text alone would not show what follows the object. Here it
    is the first of two elements of an array; the second one is put behind it and holds the hash of the text.
    If the array has these two elements, the text was one value from end to end: any other text makes the
    array longer, closes it early, or breaks it, and none can hold its own hash.
    """
    mark = F.concat(F.lit(f',{{"{END}":"'), F.xxhash64(text).cast("string"), F.lit('"}]'))
    element = T.StructType([*fields.fields, T.StructField(END, T.StringType())])
    return F.from_json(F.concat(F.lit("["), text, mark), T.ArrayType(element), _STRICT)


def is_json_object(text: Column, read: Column) -> Column:
    """True when the whole text is one JSON object in valid UTF-8, by what `parsed` gave; false, not NULL, for all else.

    A first element that is no object is NULL or makes the array NULL.
    """
    closed = F.get(read, F.lit(1))[END] == F.xxhash64(text).cast("string")
    whole = (F.size(read) == 2) & F.get(read, F.lit(0)).isNotNull() & closed
    return F.coalesce(F.is_valid_utf8(text) & whole, F.lit(False))


# Fixed value: stands in for a topic that has no name.
UNKNOWN_TOPIC = "unknown_topic"


def topic_or_unknown(topic: Column) -> Column:
    return F.when(topic != "", topic).otherwise(UNKNOWN_TOPIC)


def wrap_event(topic: Column, partition: Column, offset: Column, text: Column) -> Column:
    """`{"topic":…,"partition":…,"offset":…,"payload":<text>}` with the message text kept as it came."""
    position = F.to_json(
        F.struct(topic.alias("topic"), partition.alias("partition"), offset.alias("offset")),
        {"ignoreNullFields": "false"},
    )
    return F.concat(F.rtrim(position, F.lit("}")), F.lit(',"payload":'), text, F.lit("}"))
