"""The race operators on an order-and-event star schema.

``mapping`` derives the race tables from the star schema, ``queries`` runs the
operators on them and ``oracles`` says the same in plain SQL.
"""
