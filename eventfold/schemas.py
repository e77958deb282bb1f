"""Row shapes shared by every operator. Schemas are declared, never inferred."""

#: The Kafka source's own columns, so a Parquet log table and a topic are interchangeable.
LOG_SCHEMA = (
    "topic string, partition int, offset bigint, timestamp timestamp, key binary, value binary, "
    "headers array<struct<key:string,value:binary>>"
)
LOG_COLUMNS = ("topic", "partition", "offset", "timestamp", "key", "value", "headers")
EVENT_SCHEMA = (
    "event_id string, order_id string, sequence bigint, event_type string, occurred_at timestamp, payload variant"
)
ITEMS_TYPE = "array<struct<sku:string,qty:bigint,unit_price:bigint>>"
PAYMENT_TYPE = "struct<method:string,reference:string,amount:bigint>"
CREATED_TYPE = f"struct<customer_id:string,items:{ITEMS_TYPE},total_amount:bigint,payment:{PAYMENT_TYPE}>"
SHIPPED_TYPE = "struct<carrier:string,tracking_number:string>"
FOLD_SCHEMA = (
    "group_id string, order_id string, last_sequence bigint, state string, last_event_id string, handled_count bigint"
)
#: The stored form of a fold: the value of a changelog record.
FOLD_VALUE_TYPE = "struct<last_sequence:bigint,state:string,last_event_id:string,handled_count:bigint>"
VIOLATION_SCHEMA = (
    "group_id string, type string, order_id string, sequence bigint, expected string, observed string, "
    "partition int, offset bigint"
)
COMMAND_SCHEMA = (
    "cmd_id bigint, kind string, order_id string, event_type string, payload variant, force boolean, "
    "publish_ok boolean"
)

#: Topic names, fixed values.
LIFECYCLE_TOPIC = "order-lifecycle"
SNAPSHOT_TOPIC = "order-snapshot"
RETRY_TOPIC = "order-lifecycle.retry"
DLQ_TOPIC = "order-lifecycle.dlq"
CHANGELOG_PREFIX = "order-fold"


def changelog_topic(group_id: str) -> str:
    """Name the changelog that holds one group's folds."""
    return f"{CHANGELOG_PREFIX}.{group_id}"
