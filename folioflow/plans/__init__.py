"""The store, the engine and the driver's queries."""
