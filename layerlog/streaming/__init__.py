"""layerlog.streaming"""
