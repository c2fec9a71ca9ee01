"""quire: a PySpark-native engine for text witnesses and corpus work.

``functions`` holds column expressions, ``operators`` DataFrame operators,
``plans`` the registered queries with their SQL oracles, ``sources`` tables and
connectors, ``streaming`` the structured-streaming operators.
"""
