from tagloom.llm.template_decontamination import contaminated

FILLER = "some plain words that nobody would ever put into a question about anything at all today "


def found(spark, docs, items):
    got = contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_one_odd_slot_does_not_reject(spark):
    item = "Alice buys 3 red apples and 4 green pears at the market near the river and then Alice sells them to Bob and to Carol for 9 coins"
    half = "Alice buys 3 red apples and 4 green pears at the market near the river"
    docs = {
        1: FILLER + item,  # the first Alice is a name here, not in the item
        2: item.replace("3", "5").replace("4", "5"),  # two values became one
        3: half + " while another 7 sold for 3 in Rome and 3 in Paris",  # other values behind the quote
        4: FILLER,
    }
    assert found(spark, docs, {1: item}) == {(1, 1), (2, 1), (3, 1)}


def test_short_and_numeric_items(spark):
    items = {1: "What is the capital city of France?", 2: "Compute 12 + 7 * 3 - 4 and add 5 to 9 then 8", 3: "17 + 25"}
    docs = {1: FILLER + items[1] + " " + FILLER, 2: FILLER + items[2], 3: FILLER + "17 + 25 is it", 4: FILLER + "18 + 25 is it", 5: FILLER, 6: "Compute 12 and 7"}
    assert found(spark, docs, items) == {(1, 1), (2, 2), (3, 3)}


def test_edits_and_long_quotes(spark):
    item = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    inserted = [x for i, w in enumerate(item) for x in ([w, "extra"] if i % 12 == 11 else [w])]
    changed = ["other" if i % 10 == 9 else w for i, w in enumerate(item)]
    docs = {1: " ".join(inserted), 2: " ".join(changed), 3: FILLER + " ".join(item[20:34]), 4: FILLER + " ".join(item[20:30])}
    assert found(spark, docs, {1: " ".join(item)}) == {(1, 1), (2, 1), (3, 1)}


def test_copies_in_other_values_nearby_do_not_conflict(spark):
    item = "first box holds 7 red balls and next box holds 8 blue balls while last box holds 9 green balls so add them"
    copies = [item.replace("7", a).replace("8", b).replace("9", c) for a, b, c in (("7", "8", "9"), ("4", "5", "6"), ("1", "2", "3"))]
    assert found(spark, {1: " ".join(copies), 2: FILLER}, {1: item}) == {(1, 1)}
