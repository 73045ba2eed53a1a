"""Asofworks: point-in-time analytics on Spark DataFrames.

``operators`` holds DataFrame -> DataFrame operators, ``functions`` Column
expressions, ``sources`` readers and writers, ``plans`` whole query plans and
``streaming`` the Structured Streaming forms.
"""
