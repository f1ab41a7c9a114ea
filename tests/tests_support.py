def message_tables(spark):
    return {
        "message": spark.createDataFrame(
            [(1, "hi", 10, False, 1), (2, "ho", 20, True, 1), (3, None, 30, True, 1)],
            "rowid long, text string, date long, is_from_me boolean, handle_id long",
        ),
        "handle": spark.createDataFrame([(1, "+1555")], "rowid long, id string"),
        "chat_message_join": spark.createDataFrame([(1, 7), (2, 7)], "message_id long, chat_id long"),
        "chat": spark.createDataFrame([(7, "", 45)], "rowid long, display_name string, style int"),
        "person": spark.createDataFrame([(1, "Ann", None)], "rowid long, first string, last string"),
        "person_handle": spark.createDataFrame([(1, "+1555")], "person_id long, handle string"),
    }
