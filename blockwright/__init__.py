"""Blockwright: analysis of recorder disks and of the tables derived from them, on Spark."""
