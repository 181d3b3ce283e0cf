"""Readers and writers of the tables that the engine works on."""
