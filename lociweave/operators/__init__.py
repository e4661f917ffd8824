"""lociweave.operators"""
